"""Which source serves which day, seams, and days that have to be computed again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARCHIVE_LATENCY = 7
FORECAST_PAST = 92
HORIZON = 10


def provider_windows(
    days: DataFrame,
    today: Column,
    archive_start: str = "1950-01-01",
    latency: int = ARCHIVE_LATENCY,
    past: int = FORECAST_PAST,
    horizon: int = HORIZON,
) -> DataFrame:
    """Each day with the provider that can answer for it: the archive wherever it reaches.

    The windows slide with `today`, so they are plain columns; a day nobody covers stays NULL.
    """
    day = F.col("date")
    archive = day.between(F.lit(archive_start).cast("date"), F.date_sub(today, latency))
    forecast = day.between(F.date_sub(today, past), F.date_add(today, horizon))
    return days.withColumn(
        "provider", F.when(archive, F.lit("archive")).when(forecast, F.lit("forecast"))
    )


def runs(
    df: DataFrame, keys: Sequence[str], date: str, boundary: Column | None = None
) -> DataFrame:
    """Consecutive days as one row per run, split where `boundary` changes.

    `df` holds one row per key and day, so a window partition is at most the record long.
    """
    side = boundary if boundary is not None else F.lit(0)
    keyed = df.withColumn("_side", side)
    order = Window.partitionBy(*keys, "_side").orderBy(date)
    island = F.date_sub(F.col(date), F.row_number().over(order))
    return (
        keyed.withColumn("_island", island)
        .groupBy(*keys, "_side", "_island")
        .agg(
            F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("days")
        )
        .drop("_side", "_island")
    )


def plan_segments(planned: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The span split into runs of one provider; days without one come back as 'none'."""
    tagged = planned.withColumn("provider", F.coalesce("provider", F.lit("none")))
    return runs(tagged, [*keys, "provider"], date)


def stitch(parts: DataFrame, keys: Sequence[str], ts: str, priority: str) -> DataFrame:
    """One row per key and hour, the source with the lowest priority number winning."""
    rest = [c for c in parts.columns if c not in (*keys, ts)]
    best = F.min_by(F.struct(*rest), F.struct(priority, *rest)).alias("_kept")
    return (
        parts.groupBy(*keys, ts)
        .agg(best)
        .select(*keys, ts, *(F.col(f"_kept.{c}").alias(c) for c in rest))
    )


def broken_steps(series: DataFrame, keys: Sequence[str], hour: Column) -> DataFrame:
    """Places where an hourly series does not advance by exactly one hour."""
    order = Window.partitionBy(*keys).orderBy(hour)
    step = hour - F.lag(hour).over(order)
    return series.withColumn("step", step).where(F.col("step") != 1)


def superseded_days(
    scored: DataFrame, segments: DataFrame, today: Column, latency: int = ARCHIVE_LATENCY
) -> DataFrame:
    """Scored days drawn from the forecast that the archive now reaches.

    `segments` is (run_id, provider, start, end); each is expanded to its days, which turns the
    range join into an equi-join on run and day.
    """
    covered = segments.where(F.col("provider") == "forecast").select(
        "run_id", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("date")
    )
    reached = scored.where(F.col("date") <= F.date_sub(today, latency))
    return reached.join(covered.distinct(), ["run_id", "date"], "left_semi")


def recompute(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the fresh rows in place of the ones they replace."""
    kept = existing.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh)


def missing_years(df: DataFrame, date: str, first: int, last: int) -> DataFrame:
    wanted = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(df.select(F.year(date).alias("year")).distinct(), "year", "left_anti")


def drop_first_day(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Without the opening day of each series, whose noon window reaches before the record."""
    first = df.groupBy(*keys).agg(F.min(date).alias("_first"))
    return df.join(first, list(keys)).where(F.col(date) > F.col("_first")).drop("_first")
