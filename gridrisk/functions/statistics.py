"""Exact Poisson tails and intervals as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, exact to double precision from 10 up and by product below."""
    n = k.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.ln(i.cast("double")),
    )
    big = (
        (n + 0.5) * F.ln(n)
        - n
        + F.lit(0.9189385332046727)
        + F.lit(1.0) / (n * 12.0)
        - F.lit(1.0) / (n * n * n * 360.0)
        + F.lit(1.0) / (n * n * n * n * n * 1260.0)
    )
    return F.when(k < 2, F.lit(0.0)).when(k < 30, small).otherwise(big)


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k), each log term built from the one before.

    Only the terms within twelve deviations of the smaller of k and the mean are summed: the rest
    are below double precision, so the work grows with the root of the count.
    """
    near = F.least(k.cast("double"), mean)
    reach = F.sqrt(F.greatest(near, F.lit(0.0))) * 12.0 + 60.0
    low = F.greatest(F.floor(near - reach), F.lit(0)).cast("int")
    high = F.least(k.cast("int"), F.ceil(near + reach).cast("int"))
    first = low * F.ln(mean) - mean - log_factorial(low)
    folded = F.aggregate(
        F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), F.exp(first).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] + F.ln(mean) - F.ln(i.cast("double"))).alias("term"),
            (acc["total"] + F.exp(acc["term"] + F.ln(mean) - F.ln(i.cast("double")))).alias(
                "total"
            ),
        ),
    )
    return F.when(k < 0, F.lit(0.0)).otherwise(F.least(folded["total"], F.lit(1.0)))


def poisson_two_sided(observed: Column, expected: Column) -> Column:
    """Twice the smaller exact tail, at most 1."""
    low = poisson_cdf(observed, expected)
    high = F.lit(1.0) - poisson_cdf(observed - 1, expected)
    return F.least(F.lit(1.0), F.lit(2.0) * F.least(low, high))


def _solve_mean(count: float, upper: bool, tail: float = 0.025) -> float:
    """The mean at which the Poisson tail at `count` equals `tail`, by bisection."""
    import math

    if not upper and count == 0:
        return 0.0
    k = count if upper else count - 1

    def cdf(mean: float) -> float:
        if mean <= 0:
            return 1.0
        # summed in logs from the largest term down to what still counts
        top = min(k, mean)
        peak = top * math.log(mean) - mean - math.lgamma(top + 1)
        total, i = 0.0, int(k)
        while i >= 0:
            term = i * math.log(mean) - mean - math.lgamma(i + 1)
            total += math.exp(term)
            if term < peak - 45 and i < mean:
                break
            i -= 1
        return min(total, 1.0)

    target = tail if upper else 1.0 - tail
    low, high = 0.0, count + 20.0 + 10.0 * math.sqrt(count + 1.0)
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) > target:
            low = mid
        else:
            high = mid
        if high - low < 1e-12 * max(1.0, high):
            break
    return (low + high) / 2


INTERVAL = T.StructType(
    [T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
)


@F.pandas_udf(INTERVAL)
def garwood(counts: pd.Series) -> pd.DataFrame:
    """Exact 95% interval of a Poisson count; run on the few rows of a grouped result."""
    known = {c: (_solve_mean(c, False), _solve_mean(c, True)) for c in counts.dropna().unique()}
    missing = (float("nan"), float("nan"))
    rows = [known.get(c, missing) for c in counts]
    return pd.DataFrame(rows, columns=["low", "high"])
