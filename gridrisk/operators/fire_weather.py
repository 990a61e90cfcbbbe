"""The daily fire-weather codes: three running codes per cell, then three stateless indices.

The codes are a recursion over days, which no frame expresses. Cells are spread over partitions
and the rows of a partition sorted by day; each Arrow batch then advances every cell it holds by
one day at a time with numpy. Only one state row per cell stays in a task, never a series, and no
group is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: start-up codes
START = (85.0, 6.0, 15.0)

# fixed values: monthly day-length factors of the duff and drought codes, northern mid-latitudes
DUFF_DAY = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DROUGHT_DAY = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)


def _fine_fuel(code, temp, rh, wind, rain):
    moisture = 147.2 * (101.0 - code) / (59.5 + code)
    wet = np.maximum(rain - 0.5, 1e-12)
    gain = 42.5 * wet * np.exp(-100.0 / (251.0 - moisture)) * (1.0 - np.exp(-6.93 / wet))
    soaked = np.where(moisture > 150.0, 0.0015 * (moisture - 150.0) ** 2 * np.sqrt(wet), 0.0)
    moisture = np.where(rain > 0.5, np.minimum(moisture + gain + soaked, 250.0), moisture)

    tail = 0.18 * (21.1 - temp) * (1.0 - np.exp(-0.115 * rh))
    drying = 0.942 * rh**0.679 + 11.0 * np.exp((rh - 100.0) / 10.0) + tail
    wetting = 0.618 * rh**0.753 + 10.0 * np.exp((rh - 100.0) / 10.0) + tail

    def rate(share):
        still = 0.424 * (1.0 - share**1.7) + 0.0694 * np.sqrt(wind) * (1.0 - share**8)
        return 10.0 ** -(still * 0.581 * np.exp(0.0365 * temp))

    dried = drying + (moisture - drying) * rate(rh / 100.0)
    wetted = wetting - (wetting - moisture) * rate((100.0 - rh) / 100.0)
    moisture = np.where(
        moisture > drying, dried, np.where(moisture < wetting, wetted, moisture)
    )
    return np.clip(59.5 * (250.0 - moisture) / (147.2 + moisture), 0.0, 101.0)


def _duff(code, temp, rh, rain, month):
    effective = 0.92 * rain - 1.27
    moisture = 20.0 + np.exp(5.6348 - code / 43.43)
    safe = np.maximum(code, 1e-12)
    slope = np.where(
        code <= 33.0,
        100.0 / (0.5 + 0.3 * code),
        np.where(code <= 65.0, 14.0 - 1.3 * np.log(safe), 6.2 * np.log(safe) - 17.2),
    )
    wetter = moisture + 1000.0 * effective / (48.77 + slope * effective)
    rained = np.maximum(244.72 - 43.43 * np.log(np.maximum(wetter - 20.0, 1e-12)), 0.0)
    base = np.where(rain > 1.5, rained, code)
    length = np.asarray(DUFF_DAY)[month - 1]
    return base + 1e-6 * 189.4 * (np.maximum(temp, -1.1) + 1.1) * (100.0 - rh) * length


def _drought(code, temp, rain, month):
    effective = np.maximum(0.83 * rain - 1.27, 0.0)
    stored = 800.0 * np.exp(-code / 400.0) + 3.937 * effective
    base = np.where(rain > 2.8, np.maximum(400.0 * np.log(800.0 / stored), 0.0), code)
    length = np.asarray(DROUGHT_DAY)[month - 1]
    return base + 0.5 * np.maximum(0.36 * (np.maximum(temp, -2.8) + 2.8) + length, 0.0)


def advance(state, temp, rh, wind, rain, month):
    """One day's step of the three codes; a row with a missing input leaves its state alone."""
    ffmc, dmc, dc = state
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        new = (
            _fine_fuel(ffmc, temp, rh, wind, rain),
            _duff(dmc, temp, rh, rain, month),
            _drought(dc, temp, rain, month),
        )
    whole = ~(np.isnan(temp) | np.isnan(rh) | np.isnan(wind) | np.isnan(rain))
    kept = tuple(np.where(whole, n, o) for n, o in zip(new, state))
    return kept, tuple(np.where(whole, n, np.nan) for n in new)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Advance the cells of one partition, its rows arriving in day order."""
    place: dict = {}
    state = [np.empty(0), np.empty(0), np.empty(0)]
    for batch in batches:
        codes, cells = pd.factorize(batch["cell"])
        for cell in cells:
            if cell not in place:
                place[cell] = len(place)
        if len(place) > state[0].size:
            room = max(2 * len(place), 1024)
            state = [
                np.concatenate([s, np.full(room - s.size, start)])
                for s, start in zip(state, START)
            ]
        slots = np.fromiter((place[c] for c in cells), dtype=np.int64, count=len(cells))[codes]
        temp, rh, wind, rain = (
            batch[c].to_numpy("float64", na_value=np.nan) for c in ("t", "h", "w", "r")
        )
        month = batch["m"].to_numpy("int64")
        day = batch["d"].to_numpy("int64")
        out = np.empty((3, len(batch)))
        edges = np.flatnonzero(np.diff(day)) + 1
        for first, last in zip(np.r_[0, edges], np.r_[edges, len(batch)]):
            rows = slice(int(first), int(last))
            at = slots[rows]
            kept, shown = advance(
                tuple(s[at] for s in state), temp[rows], rh[rows], wind[rows], rain[rows], month[rows]
            )
            for k in range(3):
                state[k][at] = kept[k]
                out[k, rows] = shown[k]
        yield pd.DataFrame(
            {"cell": batch["cell"], "d": batch["d"], "w": wind, "ffmc": out[0], "dmc": out[1], "dc": out[2]}
        )


def initial_spread(ffmc: Column, wind: Column) -> Column:
    moisture = F.lit(147.2) * (F.lit(101.0) - ffmc) / (F.lit(59.5) + ffmc)
    fuel = F.lit(91.9) * F.exp(moisture * -0.1386) * (
        F.lit(1.0) + F.pow(moisture, F.lit(5.31)) / F.lit(4.93e7)
    )
    return F.lit(0.208) * F.exp(wind * 0.05039) * fuel


def build_up(dmc: Column, dc: Column) -> Column:
    both = dmc + dc * 0.4
    light = F.try_divide(dmc * dc * 0.8, both)
    heavy = dmc - (F.lit(1.0) - F.try_divide(dc * 0.8, both)) * (
        F.lit(0.92) + F.pow(dmc * 0.0114, F.lit(1.7))
    )
    return (
        F.when((dmc == 0) & (dc == 0), F.lit(0.0))
        .when(dmc <= dc * 0.4, light)
        .otherwise(F.greatest(heavy, F.lit(0.0)))
    )


def weather_index(isi: Column, bui: Column) -> Column:
    duff = F.when(bui <= 80.0, F.lit(0.626) * F.pow(bui, F.lit(0.809)) + 2.0).otherwise(
        F.lit(1000.0) / (F.lit(25.0) + F.lit(108.64) * F.exp(bui * -0.023))
    )
    scale = isi * duff * 0.1
    return F.when(
        scale > 1.0, F.exp(F.lit(2.72) * F.pow(F.ln(scale) * 0.434, F.lit(0.647)))
    ).otherwise(scale)


def fire_weather(
    daily: DataFrame,
    cell: str,
    date: str,
    temp: str,
    humidity: str,
    wind: str,
    rain: str,
    wind_to_kmh: float = 1.0,
) -> DataFrame:
    """Six codes per cell and day: running codes from start-up values, then the indices.

    No seasonal mask and no overwintering. `daily` holds one row per cell and day.
    """
    inputs = daily.select(
        F.col(cell).alias("cell"),
        F.unix_date(date).alias("d"),
        F.month(date).alias("m"),
        F.col(temp).cast("double").alias("t"),
        F.col(humidity).cast("double").alias("h"),
        (F.col(wind) * F.lit(wind_to_kmh)).cast("double").alias("w"),
        F.col(rain).cast("double").alias("r"),
    )
    spread = inputs.repartition("cell").sortWithinPartitions("d", "cell")
    schema = T.StructType(
        [
            T.StructField("cell", inputs.schema["cell"].dataType),
            T.StructField("d", T.IntegerType()),
            *(T.StructField(n, T.DoubleType()) for n in ("w", "ffmc", "dmc", "dc")),
        ]
    )
    codes = spread.mapInPandas(_run, schema)
    # NaN marks a day with a missing input
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("ffmc", "dmc", "dc")}
    isi = initial_spread(F.col("ffmc"), F.col("w"))
    bui = build_up(F.col("dmc"), F.col("dc"))
    return codes.withColumns(clean).select(
        F.col("cell").alias(cell),
        F.date_from_unix_date("d").alias(date),
        "ffmc",
        "dmc",
        "dc",
        isi.alias("isi"),
        bui.alias("bui"),
        weather_index(isi, bui).alias("fwi"),
    )
