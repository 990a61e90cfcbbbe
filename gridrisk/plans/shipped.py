"""A fitted model on disk with its calibration, and whole days scored with it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.functions.lookup import calibrated
from gridrisk.operators.calibration import isotonic_knots
from gridrisk.operators.models import Spec, cross_validate, fit, predict
from gridrisk.operators.ordering import percentile_rank

#: Knots of a calibrator; a finer fit is thinned to evenly spaced rows of them.
KNOTS = 2000


@dataclass(frozen=True)
class Calibration:
    """Knots (x, y) of the sample rate, and the log-odds from it to the record's rate and on to the window's."""

    x: tuple[float, ...]
    y: tuple[float, ...]
    log_offset: float = 0.0
    window_offset: float = 0.0

    def knots(self) -> Column:
        return F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in zip(self.x, self.y, strict=True)))


@dataclass
class Shipped:
    """What scoring needs: the pipeline, the columns it was fitted on, and the calibration."""

    model: PipelineModel
    spec: Spec
    calibration: Calibration
    notes: Mapping[str, object] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """The pipeline in its own format, the rest as one row of JSON beside it; an older one is replaced."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        spec = {**asdict(self.spec), "params": dict(self.spec.params)}
        record = json.dumps({"spec": spec, "calibration": asdict(self.calibration), "notes": dict(self.notes)})
        spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Shipped:
        record = json.loads(spark.read.text(f"{path}/record").first()[0])
        spec = {**record["spec"], "numeric": tuple(record["spec"]["numeric"])}
        calibration = {k: tuple(v) if isinstance(v, list) else v for k, v in record["calibration"].items()}
        return cls(PipelineModel.load(f"{path}/pipeline"), Spec(**spec), Calibration(**calibration), record["notes"])


def calibration_of(held_out: DataFrame, label: str, raw: str = "raw", log_offset: float = 0.0, window_offset: float = 0.0, most: int = KNOTS) -> Calibration:
    """Calibration on scores of rows that the model did not learn from; at most `most` knots reach the driver."""
    knots = isotonic_knots(held_out, label, raw)
    ordered = knots.groupBy("x").agg(F.max("y").alias("y"))
    n = ordered.count()
    if n > most:
        # quantiles of the knots' own places, first and last among them
        cuts = F.percentile_approx("x", F.array(*(F.lit(k / (most - 1)) for k in range(most))), 10 * most)
        ordered = ordered.join(ordered.agg(F.array_distinct(cuts).alias("_x")).select(F.explode("_x").alias("x")), "x")
    rows = sorted((r.x, r.y) for r in ordered.collect())
    return Calibration(tuple(x for x, _ in rows), tuple(y for _, y in rows), log_offset, window_offset)


def ship(df: DataFrame, spec: Spec, fold: str, n_folds: int, log_offset: float = 0.0, window_offset: float = 0.0) -> Shipped:
    """The model of all rows, calibrated on out-of-fold scores of the same rows."""
    held_out = cross_validate(df, spec, fold, n_folds)
    calibration = calibration_of(held_out, spec.label, log_offset=log_offset, window_offset=window_offset)
    return Shipped(fit(df, spec), spec, calibration)


def check_features(df: DataFrame, shipped: Shipped) -> None:
    """Refuse a table that lacks a column the model was fitted on."""
    missing = sorted(set(shipped.spec.numeric) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks columns the model was fitted on: {', '.join(missing)}")


def scored_days(df: DataFrame, shipped: Shipped, first: str, days: int, keep: Sequence[str] = (), key: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Key, date, raw, probability and rank of every row of `days` days from the first.

    All days are one job: the model is applied row by row, and only the rank, taken on the raw
    score since the calibrated one has plateaus, brings the rows of a day together.
    """
    check_features(df, shipped)
    start = F.lit(first).cast("date")
    wanted = df.where(F.col("date").between(start, F.date_add(start, days - 1)))
    label = {} if shipped.spec.label in df.columns else {shipped.spec.label: F.lit(0)}
    raw = predict(shipped.model, wanted.withColumns(label), shipped.spec)
    cal = shipped.calibration
    _, _, population = calibrated(F.col("raw"), cal.knots(), cal.log_offset, cal.window_offset)
    rows = raw.select(*key, "date", *keep, "raw", population.alias("probability"))
    return percentile_rank(rows, ["date"], "raw", "rank")


def day_records(df: DataFrame, scored: DataFrame, shipped: Shipped) -> DataFrame:
    """One row a scored day: cells, mean and highest probability, and how many rows lack each feature."""
    days = scored.groupBy("date").agg(F.count("*").alias("cells"), F.avg("probability").alias("mean"), F.max("probability").alias("max"))
    lacking = [F.count_if(F.col(c).isNull()).alias(c) for c in shipped.spec.numeric]
    counts = df.groupBy("date").agg(*lacking)
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("rows")) for c in shipped.spec.numeric))
    found = counts.select("date", F.filter(pairs, lambda p: p["rows"] > 0).alias("missing"))
    return days.join(found, "date", "left")


def write_days(scored: DataFrame, path: str) -> None:
    """Scored rows as Parquet folders by date; the days written are replaced, others stay."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def pending_days(spark: SparkSession, path: str, first: str, days: int) -> list[str]:
    """The days of the range that have no folder yet; at most `days` dates."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    wanted = [r[0] for r in spark.sql(f"select explode(sequence(date'{first}', date_add(date'{first}', {days - 1}))) d").selectExpr("cast(d as string)").collect()]
    there = [hadoop.Path(f"{path}/date={d}") for d in wanted]
    return [d for d, p in zip(wanted, there, strict=True) if not p.getFileSystem(conf).exists(p)]
