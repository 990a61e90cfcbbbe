"""JSON payloads, interleaved bands, band names and lattices decoded to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = -32768


def hourly_rows(
    payloads: DataFrame, column: str, key: Sequence[str], variables: Sequence[str]
) -> DataFrame:
    """JSON {latitude, longitude, hourly: {time: [], v: []}} to one row per place and hour.

    A missing variable, or one as long as no clock, fails the job.
    """
    fields = ", ".join(f"{v}: ARRAY<DOUBLE>" for v in variables)
    schema = (
        f"STRUCT<latitude: DOUBLE, longitude: DOUBLE, "
        f"hourly: STRUCT<time: ARRAY<STRING>, {fields}>>"
    )
    parsed = payloads.select(*key, F.from_json(column, schema).alias("p"))
    size = F.size("p.hourly.time")
    sound = F.lit(True)
    for v in variables:
        sound = sound & F.coalesce(F.size(f"p.hourly.{v}") == size, F.lit(False))
    checked = parsed.where(
        F.when(
            ~sound, F.raise_error(F.lit("a payload lacks a variable or an hour")).cast("boolean")
        ).otherwise(F.lit(True))
    )
    zipped = F.arrays_zip(
        F.col("p.hourly.time").alias("time"),
        *(F.col(f"p.hourly.{v}").alias(v) for v in variables),
    )
    rows = checked.select(*key, F.col("p.latitude").alias("latitude"), F.inline(zipped))
    return rows.withColumn("time", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm")))


def other_clocks(payloads: DataFrame, column: str, key: Sequence[str], like: str) -> DataFrame:
    """Payloads of a request whose clock is not the one most others of it share.

    `like` names the request; clocks are compared by their digest, counted per request.
    """
    clock = F.sha2(F.to_json(F.from_json(column, "STRUCT<hourly: STRUCT<time: ARRAY<STRING>>>")), 256)
    tagged = payloads.select(*key, like, clock.alias("_clock"))
    counts = tagged.groupBy(like, "_clock").agg(F.count("*").alias("_n"))
    main = counts.groupBy(like).agg(
        F.max_by("_clock", F.struct("_n", "_clock")).alias("_main")
    )
    return tagged.join(main, like).where(F.col("_clock") != F.col("_main")).select(*key, like)


def stacked_bands(
    df: DataFrame, bands: str, key: Sequence[str], names: Sequence[str], hours: int
) -> DataFrame:
    """Bands interleaved as hour x variable to one row per hour; wrong counts and nodata fail."""
    n = len(names)
    wrong = (F.size(bands) != hours * n) | F.array_contains(bands, F.lit(float(NODATA)))
    checked = df.where(
        F.when(
            wrong, F.raise_error(F.lit("bands are missing or hold the nodata value")).cast("boolean")
        ).otherwise(F.lit(True))
    )
    hour = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour")
    spread = checked.select(*key, bands, hour)
    return spread.select(
        *key,
        "hour",
        *(F.get(bands, F.col("hour") * n + i).alias(name) for i, name in enumerate(names)),
    )


def parse_band_name(text: Column, names: Sequence[str]) -> tuple[Column, Column]:
    """'ndvi_200307' to (ndvi, 2003-07-01); anything else is NULL in both."""
    pattern = rf"^({'|'.join(names)})_(\d{{4}})(\d{{2}})$"
    month = F.regexp_extract(text, pattern, 3)
    good = text.rlike(pattern) & month.between("01", "12")
    name = F.when(good, F.regexp_extract(text, pattern, 1))
    day = F.make_date(
        F.regexp_extract(text, pattern, 2).try_cast("int"), month.try_cast("int"), F.lit(1)
    )
    return name, F.when(good, day)


def checked_band_name(text: Column, names: Sequence[str]) -> tuple[Column, Column]:
    """The same, but a malformed name, a missing one among them, fails the job and is told."""
    name, month = parse_band_name(text, names)
    told = F.concat(F.lit("not a band name: "), F.coalesce(text, F.lit("missing")))
    return (F.coalesce(name, F.raise_error(told).cast("string")), F.coalesce(month, F.raise_error(told).cast("date")))


def band_name(name: Column, month: Column) -> Column:
    return F.concat_ws("_", name, F.date_format(month, "yyyyMM"))


def lattice_ids(points: DataFrame, lat: str, lon: str, out: str = "era5_id") -> DataFrame:
    """Ids of lattice nodes, row-major from the north-west.

    The axes are small: a row per distinct latitude and per distinct longitude.
    """
    from gridrisk.operators.joins import with_scalars
    from gridrisk.operators.ordering import row_ids

    rows = row_ids(points.select(lat).distinct(), [-F.col(lat)], "_row")
    cols = row_ids(points.select(lon).distinct(), [F.col(lon)], "_col")
    width = cols.agg(F.count("*").alias("_width"))
    joined = with_scalars(points.join(rows, lat).join(cols, lon), width)
    return joined.withColumn(out, F.col("_row") * F.col("_width") + F.col("_col")).drop(
        "_row", "_col", "_width"
    )


def join_variables(
    left: DataFrame, right: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Two variables on exactly the same places and hours; a row without its twin fails."""
    both = left.withColumn("_l", F.lit(True)).join(
        right.withColumn("_r", F.lit(True)), list(keys), "full"
    )
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    return both.where(
        F.when(
            lone, F.raise_error(F.lit("two variables differ in their hours")).cast("boolean")
        ).otherwise(F.lit(True))
    ).drop("_l", "_r")


def wide_bands(long: DataFrame, cell: str, band: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per named band; a band outside the names fails the job and is told."""
    known = F.coalesce(F.col(band).isin(*names), F.lit(False))
    told = F.raise_error(F.concat(F.lit("unexpected band: "), F.coalesce(F.col(band).cast("string"), F.lit("missing"))))
    # the group's greatest stray name, so that the check is part of the aggregate
    stray = F.max(F.when(~known, told.cast("string")))
    wide = long.groupBy(cell).agg(
        *(F.max(F.when(F.col(band) == n, F.col(value))).alias(n) for n in names), stray.alias("_stray")
    )
    return wide.where(F.col("_stray").isNull()).drop("_stray")


def long_bands(wide: DataFrame, cell: str, names: Sequence[str]) -> DataFrame:
    return wide.unpivot([cell], list(names), "band", "value")


def dense_grid(wide: DataFrame, cell: str, n_cells: int) -> DataFrame:
    """Every cell of the grid; NULL where the raster has no data."""
    spine = wide.sparkSession.range(n_cells).withColumnRenamed("id", cell)
    return spine.join(wide, cell, "left")


def static_block(
    long: DataFrame, active: DataFrame, keys: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Named bands of the active cells as columns, one row per cell (and month)."""
    kept = long.join(active.select("cell_id"), "cell_id", "left_semi")
    return kept.groupBy(*keys).agg(
        *(F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names)
    )


def orography(
    nodes: DataFrame, geopotential: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Height of every backbone node from the geopotential at the same place.

    A node without a value fails the job.
    """
    from gridrisk.functions.physics import STANDARD_GRAVITY

    joined = nodes.join(geopotential, list(keys), "left")
    height = F.when(
        F.col(value).isNull(),
        F.raise_error(F.lit("a backbone node lies off the orography")).cast("double"),
    ).otherwise(F.col(value) / F.lit(STANDARD_GRAVITY))
    return joined.select(*nodes.columns, height.alias("height"))


