"""Scoring whole grids: every requested day in one job, then written by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.functions.lookup import calibrated
from gridrisk.operators.daily import daily_aggregates, with_weather
from gridrisk.operators.ordering import percentile_rank
from gridrisk.operators.ranking import top_k


def ranked_trailing_days(hourly: DataFrame, top: int, days: int = 7) -> DataFrame:
    """The slice from end to end: local days, trailing mean, rank within the day, the top rows.

    The trailing mean is over the days present of the last week, so that sparse cells count.
    """
    daily = daily_aggregates(with_weather(hourly))
    number = F.unix_date("date")
    frame = Window.partitionBy("cell_id").orderBy(number).rangeBetween(-(days - 1), 0)
    trailing = daily.select(
        "cell_id",
        "date",
        F.avg("temp_mean").over(frame).alias("temp_mean_trailing"),
        F.count("temp_mean").over(frame).alias("days_seen"),
    )
    ranked = percentile_rank(trailing, ["date"], "temp_mean_trailing", "day_rank")
    return top_k(
        ranked,
        top,
        F.desc("day_rank"),
        F.desc("temp_mean_trailing"),
        F.asc("date"),
        F.asc("cell_id"),
    )


def score_days(
    frame: DataFrame,
    raw: Column,
    knots: Column,
    log_offset: float,
    window_offset: float,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Raw score, population-rate probability and within-day rank of every cell and day.

    The rank is on the raw score: the calibrated one has plateaus.
    """
    _, _, population = calibrated(F.col("raw"), knots, log_offset, window_offset)
    scored = frame.withColumn("raw", raw).select("cell_id", "date", "raw", *keep)
    return percentile_rank(scored.withColumn("probability", population), ["date"], "raw", "rank")
