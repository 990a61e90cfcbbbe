"""Hourly rows to local-day aggregates, every statistic in one map-side combined pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.physics import (
    relative_humidity,
    rung_column,
    unclipped_humidity,
    vapor_pressure_deficit,
    clip,
    wind_from,
    wind_speed,
    wrap_degrees,
)

NOON = 12


def local_time(ts: str, offset_hours: int = 1) -> Column:
    """Fixed local standard time, no daylight saving."""
    return F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(offset_hours))


def circular_mean(degrees: Column) -> Column:
    """Mean bearing; an arithmetic mean of 350 and 10 would point south."""
    radians = F.radians(degrees)
    return wrap_degrees(F.degrees(F.atan2(F.avg(F.sin(radians)), F.avg(F.cos(radians)))))


def at_first_maximum(value: Column, of: Column, order: Column) -> Column:
    """`value` at the highest `of`, the earliest row winning a tie."""
    return F.max_by(value, F.struct(of, -order))


def at_hour(value: Column, hour: Column, wanted: int = NOON) -> Column:
    return F.max(F.when(hour == wanted, value))


def with_weather(hourly: DataFrame, ts: str = "ts", offset_hours: int = 1) -> DataFrame:
    """Humidity, deficit and wind at the hourly step, where their non-linearity belongs."""
    local = local_time(ts, offset_hours)
    return hourly.withColumns(
        {
            "date": F.to_date(local),
            "local_hour": F.hour(local),
            "minute_of_day": F.hour(local) * 60 + F.minute(local),
            "rh": relative_humidity(F.col("temp_c"), F.col("dewpoint_c")),
            "vpd": vapor_pressure_deficit(F.col("temp_c"), F.col("dewpoint_c")),
            "wind_speed": wind_speed(F.col("u10"), F.col("v10")),
            "wind_dir": wind_from(F.col("u10"), F.col("v10")),
        }
    )


def daily_aggregates(
    hourly: DataFrame,
    key: Sequence[str] = ("cell_id",),
    rungs: Sequence[int] = (),
    tie: str = "minute_of_day",
) -> DataFrame:
    """One row per cell and local day off `with_weather`: the daily backbone.

    Statistics at each lapse rung are generated into the same pass, so the hourly rows are not
    multiplied by the number of rungs.
    """
    out = [F.count("*").alias("n_hours")]
    for short, source in (("temp", "temp_c"), ("rh", "rh"), ("pres", "pres_hpa")):
        out += [
            F.avg(source).alias(f"{short}_mean"),
            F.min(source).alias(f"{short}_min"),
            F.max(source).alias(f"{short}_max"),
            (F.max(source) - F.min(source)).alias(f"{short}_range"),
        ]
    speed, bearing = F.col("wind_speed"), F.col("wind_dir")
    hour = F.col("local_hour")
    out += [
        F.max("vpd").alias("vpd_max"),
        F.sum("precip_mm").alias("precip_sum"),
        F.avg(speed).alias("wind_speed_mean"),
        F.max(speed).alias("wind_speed_max"),
        circular_mean(bearing).alias("wind_dir_mean"),
        at_first_maximum(bearing, speed, F.col(tie)).alias("wind_dir_at_max"),
        at_hour(F.col("temp_c"), hour).alias("temp_noon"),
        at_hour(F.col("rh"), hour).alias("rh_noon"),
        at_hour(speed, hour).alias("wind_speed_noon"),
    ]
    out += rung_statistics(rungs)
    return hourly.groupBy(*key, "date").agg(*out)


def rung_statistics(rungs: Sequence[int]) -> list[Column]:
    """Humidity and deficit again with temperatures some kelvin warmer, per rung."""
    out = []
    for rung in rungs:
        warm = F.col("temp_c") + F.lit(float(rung))
        ratio = unclipped_humidity(warm, F.col("dewpoint_c"))
        out += [
            F.avg(clip(ratio, 0.0, 100.0)).alias(rung_column("rh_mean", rung)),
            F.min(ratio).alias(rung_column("rh_min", rung)),
            F.max(ratio).alias(rung_column("rh_max", rung)),
            at_hour(ratio, F.col("local_hour")).alias(rung_column("rh_noon", rung)),
            F.max(vapor_pressure_deficit(warm, F.col("dewpoint_c"))).alias(
                rung_column("vpd_max", rung)
            ),
        ]
    return out


def whole_days(
    hourly: DataFrame, key: Sequence[str], date: str, hour: str, needed: int = 24
) -> DataFrame:
    """Only the days with at least `needed` different hours."""
    return (
        hourly.groupBy(*key, date)
        .agg(F.count_distinct(hour).alias("hours"))
        .where(F.col("hours") >= needed)
    )


def daily_statistics(
    df: DataFrame, key: Sequence[str], date: Column, columns: dict[str, Sequence[str]]
) -> DataFrame:
    """Mean, maximum or sum of auxiliary fields per day or month, from one mapping."""
    known = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    out = [
        known[kind](name).alias(f"{name}_{kind}")
        for name, kinds in columns.items()
        for kind in kinds
    ]
    return df.groupBy(*key, date.alias("date")).agg(*out)
