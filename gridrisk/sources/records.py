"""CSV scans: cases validated field by field, and fixed-length daily tracks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.functions.repair import blank_to_null, day_first_date, decimal_comma

# fixed values: the closed lists of the case file
CAUSES = ("lightning", "human", "unknown")
COORD_SOURCES = ("report", "map", "cell", "municipality", "cadastre")

CASE_COLUMNS = (
    "id",
    "date",
    "time",
    "lat",
    "lon",
    "uncertainty_m",
    "coord_source",
    "place",
    "municipality",
    "area_ha",
    "cause",
    "source",
    "notes",
)


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV as text columns only, so that nothing is lost before it has been looked at."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)


def parse_cases(text: DataFrame) -> DataFrame:
    """Typed columns beside an array with the name of every field that is wrong.

    Expects all of `CASE_COLUMNS` as text.
    """
    clean = {c: blank_to_null(F.col(c)) for c in CASE_COLUMNS}
    typed = {
        "id": clean["id"],
        "date": day_first_date(F.col("date")),
        "hour": F.regexp_extract(clean["time"], r"^(\d{1,2}):\d{2}", 1).try_cast("int"),
        "lat": decimal_comma(F.col("lat")),
        "lon": decimal_comma(F.col("lon")),
        "uncertainty_m": decimal_comma(F.col("uncertainty_m")),
        "coord_source": clean["coord_source"],
        "place": clean["place"],
        "municipality": clean["municipality"],
        "area_ha": decimal_comma(F.col("area_ha")),
        "cause": clean["cause"],
        "source": clean["source"],
        "notes": clean["notes"],
    }

    def outside(name: str, low: float, high: float | None) -> Column:
        v = typed[name]
        return v.isNull() | (v < low) | ((v > high) if high is not None else F.lit(False))

    bad = {
        "id": typed["id"].isNull() | typed["id"].rlike(r"\s"),
        "date": typed["date"].isNull(),
        "time": clean["time"].isNotNull() & ~F.coalesce(typed["hour"].between(0, 23), F.lit(False)),
        "lat": outside("lat", -90, 90),
        "lon": outside("lon", -180, 180),
        "uncertainty_m": outside("uncertainty_m", 0, None),
        "coord_source": ~F.coalesce(typed["coord_source"].isin(*COORD_SOURCES), F.lit(False)),
        "place": typed["place"].isNull(),
        "area_ha": clean["area_ha"].isNotNull() & outside("area_ha", 0, None),
        "cause": ~F.coalesce(typed["cause"].isin(*CAUSES), F.lit(False)),
    }
    flags = F.array(*(F.when(flag, F.lit(name)) for name, flag in bad.items()))
    rest = [c for c in text.columns if c not in CASE_COLUMNS]
    return text.select(
        *rest, *(v.alias(k) for k, v in typed.items()), F.array_compact(flags).alias("errors")
    )


def mark_repeated(parsed: DataFrame) -> DataFrame:
    """Add 'id' to the errors of every row whose id another row has too."""
    counts = parsed.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return (
        parsed.join(counts, "id", "left")
        .withColumn(
            "errors",
            F.when(
                F.col("_n").isNotNull(), F.array_union("errors", F.array(F.lit("repeated id")))
            ).otherwise(F.col("errors")),
        )
        .drop("_n")
    )


def split_cases(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the quarantined ones with it."""
    wrong = F.size("errors") > 0
    return parsed.where(~wrong).drop("errors"), parsed.where(wrong)


def target_days(
    rows: DataFrame,
    track: Sequence[Column],
    step: str,
    length: int,
    target: int,
    rain: str,
    windows: Sequence[int],
    features: Mapping[str, Column],
) -> DataFrame:
    """One row per fixed-length track: its target day's features and trailing rain sums.

    A track of another length fails the job. The sums come from one aggregate per track, `length`
    rows wide by contract; no window is needed.
    """
    keyed = rows.withColumn("track_id", F.concat_ws("-", *track))
    first = target - F.col(step)
    out = [F.count("*").alias("_rows")]
    out += [
        F.sum(F.when((first >= 0) & (first < w), F.col(rain))).alias(f"precip_cum{w}_mm")
        for w in windows
    ]
    out += [F.max(F.when(F.col(step) == target, c)).alias(n) for n, c in features.items()]
    tracks = keyed.groupBy("track_id").agg(*out)
    whole = F.when(
        F.col("_rows") != length,
        F.raise_error(F.lit(f"a track is not {length} days long")).cast("boolean"),
    ).otherwise(F.lit(True))
    return tracks.where(whole).drop("_rows")


def ragged_tracks(rows: DataFrame, track: Sequence[Column], length: int) -> DataFrame:
    keyed = rows.withColumn("track_id", F.concat_ws("-", *track))
    sizes = keyed.groupBy("track_id").agg(F.count("*").alias("days"))
    return sizes.where(F.col("days") != length)


def labelled_tracks(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both files as one table; the file's name in the id keeps their numbers apart."""
    return positives.withColumn("label", F.lit(1)).unionByName(
        negatives.withColumn("label", F.lit(0))
    )
