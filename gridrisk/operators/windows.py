"""Trailing windows over daily and hourly series.

Every series holds one row per cell and day (or hour) by the time it gets here, so a window
partition is never longer than the record: about 15,000 days or 360,000 hours in 41 years, however
many raw rows the cell had. `one_row_per` makes that so for raw rows. Frames are RANGE frames over
the day number: a window with a missing day or value is NULL, wherever the gap lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS_PER_HOUR = 3600


def day_number(date: str | Column) -> Column:
    return F.unix_date(F.to_date(date) if isinstance(date, Column) else F.to_date(F.col(date)))


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch of a zone-less timestamp."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)


def one_row_per(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Collapse raw rows to the series grain; combined before the shuffle."""
    return df.groupBy(*keys).agg(*aggregates)


def _over(key: Sequence[str], date: str, first: int, last: int):
    return Window.partitionBy(*key).orderBy(day_number(date)).rangeBetween(first, last)


def trailing_sum(key: Sequence[str], date: str, value: str, window: int) -> Column:
    """Sum over the window ending on the day itself."""
    if window < 1:
        raise ValueError(f"a window needs at least one day, got {window}")
    frame = _over(key, date, -(window - 1), 0)
    return F.when(F.count(value).over(frame) == window, F.sum(value).over(frame))


def trailing_mean(key: Sequence[str], date: str, value: str, window: int) -> Column:
    return trailing_sum(key, date, value, window) / F.lit(window)


def preceding_max(key: Sequence[str], date: str, value: str, window: int) -> Column:
    """Highest value of the days before the row's own."""
    frame = _over(key, date, -window, -1)
    return F.when(F.count(value).over(frame) == window, F.max(value).over(frame))


def days_since(key: Sequence[str], date: str, value: str, threshold: float, cap: int) -> Column:
    """Days back to the last value at or above the threshold, at most `cap`.

    Unknown until such a day has been seen or the series is `cap` days old. Only `cap` days back
    can matter, so the frame is that long.
    """
    number = day_number(date)
    last = F.max(F.when(F.col(value) >= threshold, number)).over(_over(key, date, -cap, 0))
    age = number - F.min(number).over(Window.partitionBy(*key))
    return (
        F.when(last.isNotNull(), F.least(number - last, F.lit(cap)))
        .when(age + 1 >= cap, F.lit(cap))
        .cast("double")
    )


def carry_forward(
    df: DataFrame,
    key: Sequence[str],
    date: str,
    bands: Sequence[str],
    observed: Column,
    max_days: int,
    age: str = "age_days",
) -> DataFrame:
    """Each cell's bands from its last observed composite within `max_days`, and its age.

    All bands come from the same composite, NULL bands of it included.
    """
    frame = _over(key, date, -max_days, 0)
    packed = F.struct(F.col(date).alias("_seen"), *(F.col(b).alias(b) for b in bands))
    source = F.last(F.when(observed, packed), ignorenulls=True).over(frame)
    return (
        df.withColumn("_source", source)
        .withColumns({b: F.col(f"_source.{b}") for b in bands})
        .withColumn(age, F.date_diff(F.col(date), F.col("_source._seen")).cast("float"))
        .drop("_source")
    )


def latest_within(
    df: DataFrame,
    key: Sequence[str],
    date: str,
    composite: Column,
    bands: Sequence[str],
    observed: Column,
    max_days: int,
    age: str = "age_days",
) -> DataFrame:
    """The block one composite month can be served with: the newest month in reach, filled.

    Months outside the reach cannot change the answer, so they are dropped before the window.
    """
    reach = F.trunc(F.date_sub(composite, max_days), "month")
    inside = df.where((F.col(date) >= reach) & (F.col(date) <= composite))
    newest = inside.agg(F.max(date).alias("_newest"))
    filled = carry_forward(inside, key, date, bands, observed, max_days, age)
    # one row, so the broadcast is bounded
    return filled.join(
        F.broadcast(newest), F.col(date) == F.col("_newest"), "left_semi"
    )


def deaccumulate(key: Sequence[str], ts: str, total: str) -> Column:
    """Hourly amounts from a running total that restarts at 01 UTC; negatives read as 0."""
    order = Window.partitionBy(*key).orderBy(ts)
    step = F.when(F.hour(F.col(ts)) == 1, F.col(total)).otherwise(
        F.col(total) - F.lag(total).over(order)
    )
    return F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))


def sum_to_hour(
    key: Sequence[str], local_ts: str, value: str, hours: int = 24
) -> Column:
    """Sum of the `hours` hours ending with the row's own; NULL unless every hour is there."""
    frame = (
        Window.partitionBy(*key)
        .orderBy(hour_number(F.col(local_ts)))
        .rangeBetween(-(hours - 1), 0)
    )
    return F.when(F.count(value).over(frame) == hours, F.sum(value).over(frame))


def gap_before(key: Sequence[str], date: str) -> Column:
    """Days missing between a row and the row before it in the series."""
    order = Window.partitionBy(*key).orderBy(date)
    return F.date_diff(F.col(date), F.lag(date).over(order)) - 1


def change(key: Sequence[str], date: str, value: str) -> Column:
    order = Window.partitionBy(*key).orderBy(date)
    return F.col(value) - F.lag(value).over(order)
