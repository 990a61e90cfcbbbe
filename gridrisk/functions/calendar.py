"""Calendar features, spans of days and months, and bins over years, sizes and hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: month -> season
SEASONS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}

# fixed values: Italian public holidays with a fixed date, (month, day)
FIXED_HOLIDAYS = (
    (1, 1),
    (1, 6),
    (4, 25),
    (5, 1),
    (6, 2),
    (8, 15),
    (11, 1),
    (12, 8),
    (12, 25),
    (12, 26),
)


def season(month: Column) -> Column:
    out = None
    for name, months in SEASONS.items():
        hit = month.isin(*months)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous algorithm, in column arithmetic."""
    golden = year % 19
    century = _div(year, 100)
    rest = year % 100
    leap = _div(century, 4)
    shift = _div(century - _div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - leap - shift + 15) % 30
    weekday = (F.lit(32) + (century % 4) * 2 + _div(rest, 4) * 2 - epact - rest % 4) % 7
    late = _div(golden + epact * 11 + weekday * 22, 451)
    number = epact + weekday - late * 7 + 114
    return F.make_date(year, _div(number, 31), number % 31 + 1)


def is_public_holiday(date: Column) -> Column:
    fixed = F.lit(False)
    for month, day in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(date) == month) & (F.dayofmonth(date) == day))
    easter = easter_sunday(F.year(date))
    return fixed | (date == easter) | (date == F.date_add(easter, 1))


def calendar_features(dates: DataFrame, date: str = "date") -> DataFrame:
    """Month, season, weekday (Monday 0), weekend and public holiday of each distinct day."""
    day = F.col(date)
    return dates.select(day).distinct().select(
        day,
        F.month(day).cast("tinyint").alias("month"),
        season(F.month(day)).alias("season"),
        F.weekday(day).cast("tinyint").alias("day_of_week"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        is_public_holiday(day).alias("is_holiday"),
    )


def days_between(start: Column, end: Column, step: int = 1) -> Column:
    return F.when(start <= end, F.sequence(start, end, F.expr(f"interval {step} day")))


def month_starts(start: Column, end: Column) -> Column:
    """First day of every month touched by [start, end]."""
    first = F.to_date(F.trunc(start, "month"))
    last = F.to_date(F.trunc(end, "month"))
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))


def preceding_month(date: Column) -> Column:
    return F.add_months(F.trunc(date, "month"), -1)


def months_in_reach(composite: Column, max_days: int) -> Column:
    """The composite months that can still supply a value for `composite`."""
    return month_starts(F.date_sub(composite, max_days), composite)


def month_end(date: Column) -> Column:
    return F.last_day(date)


def spinup_window(first: Column, last: Column, today: Column, spinup: int, horizon: int) -> Column:
    """The whole months to fetch so that [first, last] has its history, up to the horizon."""
    return F.struct(
        F.to_date(F.trunc(F.date_sub(first, spinup), "month")).alias("start"),
        F.least(month_end(last), F.date_add(today, horizon)).alias("end"),
    )


def season_window(year: Column, month: int = 8, days: int = 15) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return days_between(first, F.date_add(first, days - 1))


def opening_days(start: Column, end: Column, days: int = 10) -> Column:
    """The first days of every month, clipped to the span: one (first, last) per month."""
    spans = F.transform(
        month_starts(start, end),
        lambda m: F.struct(
            F.greatest(m, start).alias("first"),
            F.least(F.date_add(m, days - 1), end).alias("last"),
        ),
    )
    return F.filter(spans, lambda s: s["first"] <= s["last"])


def half_years(start: Column, end: Column) -> Column:
    """Half-open half-year windows that tile [start, end] exactly once."""
    anchor = F.make_date(F.year(start), F.when(F.month(start) <= 6, 1).otherwise(7), F.lit(1))
    return F.transform(
        F.sequence(anchor, end, F.expr("interval 6 month")),
        lambda h: F.struct(
            F.greatest(h, start).alias("from_day"),
            F.least(F.add_months(h, 6), F.date_add(end, 1)).alias("to_day"),
        ),
    )


def chunk_start(month: Column, size: int) -> Column:
    """First month of the fetch chunk a month belongs to, chunks counted from January."""
    back = (F.month(month) - 1) % F.lit(size)
    return F.add_months(F.trunc(month, "month"), -back)


def bin_start(value: Column, edges: Sequence[float]) -> Column:
    """Lower edge of the right-open bin a value falls in; NULL below the first edge."""
    out = F.lit(None)
    for edge in sorted(edges):
        out = F.when(value >= edge, F.lit(edge)).otherwise(out)
    return out


def bin_label(value: Column, edges: Sequence[int]) -> Column:
    """'03-05' for the right-open bin [3, 6); NULL outside the edges."""
    out = None
    for low, high in zip(edges[:-1], edges[1:]):
        hit = (value >= low) & (value < high)
        label = F.lit(f"{low:02d}-{high - 1:02d}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def period_label(year: Column, periods: Sequence[tuple[int, int]]) -> Column:
    out = None
    for first, last in periods:
        hit = year.between(first, last)
        label = F.lit(f"{first}-{last}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def decade_labels(df: DataFrame, year: str, edges: Sequence[int], out: str = "decade") -> DataFrame:
    """Each decade named by the years it really holds.

    The spans come from one small aggregate (a row per decade), joined back by a broadcast.
    """
    start = bin_start(F.col(year), edges)
    tagged = df.withColumn("_start", start)
    spans = tagged.groupBy("_start").agg(
        F.concat_ws(
            "-", F.min(year).cast("string"), F.max(year).cast("string")
        ).alias(out)
    )
    # one row per edge at most, so the broadcast is bounded by len(edges)
    return tagged.join(F.broadcast(spans), "_start", "left").drop("_start")


def calendar_span(spark: SparkSession, start: str, end: str, date: str = "date") -> DataFrame:
    """Every day of a span, generated on the executors."""
    return spark.range(1).select(
        F.explode(
            F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
        ).alias(date)
    )
