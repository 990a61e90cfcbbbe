"""Piecewise-linear lookups, breaks and ladders held as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def knots(xs: Sequence[float], ys: Sequence[float]) -> Column:
    """A fixed knot list as array<struct<x, y>>."""
    return F.array(
        *(
            F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
            for x, y in zip(xs, ys, strict=True)
        )
    )


def strictly_rising(points: Column) -> Column:
    """Drop every knot whose x does not exceed the x before it."""
    n = F.size(points)
    kept = F.filter(
        F.transform(
            points,
            lambda p, i: F.struct(
                p["x"].alias("x"),
                p["y"].alias("y"),
                ((i == 0) | (p["x"] > F.get(points, i - 1)["x"])).alias("keep"),
            ),
        ),
        lambda p: p["keep"],
    )
    return F.when(
        n > 0,
        F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))),
    )


def interpolate(value: Column, points: Column) -> Column:
    """Linear between knots sorted by a rising x, held flat beyond both ends."""
    n = F.size(points)
    at = F.size(F.filter(points, lambda p: p["x"] <= value))
    low = F.get(points, F.greatest(at - 1, F.lit(0)))
    high = F.get(points, F.least(at, n - 1))
    slope = F.try_divide(high["y"] - low["y"], high["x"] - low["x"])
    line = low["y"] + F.coalesce(slope, F.lit(0.0)) * (value - low["x"])
    return (
        F.when(value.isNull() | points.isNull(), F.lit(None).cast("double"))
        .when(at == 0, F.get(points, F.lit(0))["y"])
        .when(at >= n, F.get(points, n - 1)["y"])
        .otherwise(line)
    )


def classify(value: Column, breaks: Column | Sequence[float]) -> Column:
    """Class index: a value on a break belongs to the class the break opens; NULL is -1."""
    if not isinstance(breaks, Column):
        breaks = F.array(*(F.lit(float(b)) for b in breaks))
    index = F.size(F.filter(breaks, lambda b: b <= value))
    return F.when(value.isNull(), F.lit(-1)).otherwise(index).cast("tinyint")


def ladder_percentile(value: Column, ladder: Column) -> Column:
    """Where a value sits on an evenly spaced ladder of quantiles, in percent to one place."""
    steps = F.size(ladder) - 1
    rung = F.size(F.filter(ladder, lambda q: q <= value)) - 1
    held = F.least(F.greatest(rung, F.lit(0)), steps)
    return F.when(value.isNotNull(), F.bround(F.lit(100.0) * held / steps, 1))


def ladder_value(ladder: Column, level: float) -> Column:
    """The rung at a level in percent, e.g. the 99.9th of a thousand-step ladder."""
    steps = F.size(ladder) - 1
    return F.get(ladder, F.bround(F.lit(level) / 100.0 * steps, 0).cast("int"))


def calibrated(
    raw: Column, points: Column, log_offset: float, window_offset: float = 0.0
) -> tuple[Column, Column, Column]:
    """Sample rate off the knots, log-odds on the record's rate, and the population rate."""
    from gridrisk.functions.physics import inverse_logit, logit

    sample = interpolate(raw, points)
    record = logit(sample) + F.lit(log_offset)
    return sample, record, inverse_logit(record + F.lit(window_offset))
