"""Units, humidity, vapour pressure, wind and height correction as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: Magnus coefficients over water and the saturation pressure at 0 C, hPa
MAGNUS_A = 17.625
MAGNUS_B = 243.04
MAGNUS_E0 = 6.1094

# fixed values: reanalysis field -> (factor, addend) into C, hPa and mm
REANALYSIS_UNITS = {
    "t2m": (1.0, -273.15),
    "d2m": (1.0, -273.15),
    "sp": (0.01, 0.0),
    "tp": (1000.0, 0.0),
}

STANDARD_GRAVITY = 9.80665
DAYS_PER_YEAR = 365.25


def rescale(df: DataFrame, scaling: Mapping[str, tuple[str, float, float]]) -> DataFrame:
    """Add each target as source x factor + addend, all from one mapping."""
    return df.withColumns(
        {out: F.col(src) * F.lit(k) + F.lit(b) for out, (src, k, b) in scaling.items()}
    )


def _magnus(temp: Column) -> Column:
    return F.lit(MAGNUS_A) * temp / (F.lit(MAGNUS_B) + temp)


def unclipped_humidity(temp: Column, dewpoint: Column) -> Column:
    return F.lit(100.0) * F.exp(_magnus(dewpoint) - _magnus(temp))


def clip(value: Column, low: float, high: float) -> Column:
    """Bounded value, NULL staying NULL (greatest and least skip NULLs)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def relative_humidity(temp: Column, dewpoint: Column) -> Column:
    return clip(unclipped_humidity(temp, dewpoint), 0.0, 100.0)


def vapor_pressure_deficit(temp: Column, dewpoint: Column) -> Column:
    gap = F.lit(MAGNUS_E0) * F.exp(_magnus(temp)) - F.lit(MAGNUS_E0) * F.exp(_magnus(dewpoint))
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def wrap_degrees(bearing: Column) -> Column:
    """Into [0, 360); a tiny negative angle must not come out as 360."""
    wrapped = F.pmod(bearing, F.lit(360.0))
    return F.when(wrapped >= 360.0, F.lit(0.0)).otherwise(wrapped)


def stored_bearing(bearing: Column) -> Column:
    """As float32, where a bearing just under 360 rounds up to 360 and has to wrap again."""
    narrow = wrap_degrees(bearing).cast("float")
    return F.when(narrow >= F.lit(360.0).cast("float"), F.lit(0.0).cast("float")).otherwise(narrow)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_from(u: Column, v: Column) -> Column:
    """The bearing the wind blows from."""
    return wrap_degrees(F.lit(270.0) - F.degrees(F.atan2(v, u)))


def return_period_years(probability: Column) -> Column:
    return F.try_divide(F.lit(1.0), probability * F.lit(DAYS_PER_YEAR))


def recency_weight(year: Column, last: int, half_life: float) -> Column:
    return F.pow(F.lit(0.5), (F.lit(last) - year) / F.lit(half_life))


def logit(p: Column, floor: float = 1e-9) -> Column:
    bounded = clip(p, floor, 1.0 - floor)
    return F.ln(bounded / (F.lit(1.0) - bounded))


def inverse_logit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def odds(p: Column, floor: float = 1e-7) -> Column:
    return p / (F.lit(1.0) - F.least(p, F.lit(1.0 - floor)))


def lapse_offset(elevation: Column, backbone_height: Column, rate: float = 6.5) -> Column:
    """Kelvin to add to the backbone temperature; negative where the cell stands higher."""
    return F.lit(-rate) * (elevation - backbone_height) / F.lit(1000.0)


def rung_column(name: str, rung: int) -> str:
    return f"{name}_dt{rung:+d}".replace("+", "p").replace("-", "m")


def blend_rungs(values: Sequence[Column], rungs: Sequence[float], offset: Column) -> Column:
    """Linear between the two rung values that bracket the offset; NULL outside the rungs."""
    steps = None
    for low in range(len(rungs) - 1):
        fraction = (offset - F.lit(float(rungs[low]))) / F.lit(float(rungs[low + 1] - rungs[low]))
        line = (F.lit(1.0) - fraction) * values[low] + fraction * values[low + 1]
        top = offset < rungs[low + 1] if low + 2 < len(rungs) else offset <= rungs[low + 1]
        inside = (offset >= rungs[low]) & top
        steps = F.when(inside, line) if steps is None else steps.when(inside, line)
    return steps


def apply_lapse(
    df: DataFrame,
    offset: str,
    rungs: Sequence[int],
    shifted: Sequence[str],
    blended: Sequence[str],
    clip_after: Sequence[str],
    suffix: str = "_lapse",
) -> DataFrame:
    """Shift temperatures by the offset and read humidity between the rungs.

    Humidity kept unclipped at the rungs is clipped after the blend; its range is taken again
    from the clipped ends. Rung columns and the offset are dropped.
    """
    at = F.col(offset)
    added = {f"{name}{suffix}": (F.col(name) + at).cast("float") for name in shifted}
    for name in blended:
        value = blend_rungs([F.col(rung_column(name, r)) for r in rungs], rungs, at)
        if name in clip_after:
            value = clip(value, 0.0, 100.0)
        added[f"{name}{suffix}"] = value.cast("float")
    if {"rh_min", "rh_max"} <= set(blended):
        ends = [
            clip(blend_rungs([F.col(rung_column(n, r)) for r in rungs], rungs, at), 0.0, 100.0)
            for n in ("rh_max", "rh_min")
        ]
        added[f"rh_range{suffix}"] = (ends[0] - ends[1]).cast("float")
    spent = [rung_column(name, r) for name in blended for r in rungs] + [offset]
    return df.withColumns(added).drop(*spent)
