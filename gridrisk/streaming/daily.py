"""Local-day aggregates of hours as they arrive: the operational day without re-running it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.physics import relative_humidity


def daily_stream(
    hourly: DataFrame, late: str = "6 hours", ts: str = "ts", offset_hours: int = 1
) -> DataFrame:
    """Temperature, humidity and rain per cell and local day, out once the day is closed.

    A day closes when the watermark passes its end; hours later than `late` are left out. State
    is one small row per cell and open day.
    """
    stamped = hourly.withColumns(
        {
            "_ts": F.col(ts).cast("timestamp"),
            "_rh": relative_humidity(F.col("temp_c"), F.col("dewpoint_c")),
        }
    ).withWatermark("_ts", late)
    # a local day starts `offset_hours` before midnight UTC
    day = F.window("_ts", "1 day", "1 day", f"{24 - offset_hours} hours")
    return (
        stamped.groupBy("cell_id", day.alias("_day"))
        .agg(
            F.count("*").alias("n_hours"),
            F.avg("temp_c").alias("temp_mean"),
            F.min("temp_c").alias("temp_min"),
            F.max("temp_c").alias("temp_max"),
            F.avg("_rh").alias("rh_mean"),
            F.sum("precip_mm").alias("precip_sum"),
        )
        .withColumn(
            "date", F.to_date(F.col("_day.start") + F.make_dt_interval(F.lit(0), F.lit(offset_hours)))
        )
        .drop("_day")
    )
