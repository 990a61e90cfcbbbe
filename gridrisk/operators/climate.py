"""Normals, percentile ladders, quantile mapping, plausibility and lapse offsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.lookup import interpolate, strictly_rising
from gridrisk.functions.physics import lapse_offset
from gridrisk.operators.joins import join_to_one
from gridrisk.operators.ordering import bounded_ladder

RUNGS = 101


def plausible(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """NULL for every value a correct input cannot hold."""
    return df.withColumns(
        {name: F.when(F.col(name).between(low, high), F.col(name)) for name, (low, high) in bounds.items()}
    )


def seasonal_normals(
    df: DataFrame,
    cell: str,
    date: str,
    values: Sequence[str],
    fresh: Column,
    min_years: int = 5,
) -> DataFrame:
    """Mean, sample deviation and count per cell and calendar month, from fresh rows only.

    A month seen in fewer years than `min_years` keeps its count but no normal.
    """
    out = []
    for v in values:
        enough = F.count(v) >= min_years
        out += [
            F.when(enough, F.avg(v)).cast("float").alias(f"{v}_mean"),
            F.when(enough, F.stddev_samp(v)).cast("float").alias(f"{v}_std"),
            F.count(v).cast("smallint").alias(f"{v}_count"),
        ]
    return (
        df.where(fresh).groupBy(cell, F.month(date).cast("smallint").alias("month")).agg(*out)
    )


def fill_from_normals(
    df: DataFrame, normals: DataFrame, cell: str, date: str, values: Sequence[str]
) -> DataFrame:
    """Put the cell's seasonal normal wherever a value is missing."""
    means = normals.select(cell, "month", *(F.col(f"{v}_mean").alias(f"_{v}") for v in values))
    keyed = df.withColumn("month", F.month(date).cast("smallint"))
    joined = join_to_one(keyed, means, [cell, "month"])
    return joined.withColumns({v: F.coalesce(v, f"_{v}") for v in values}).drop(
        "month", *(f"_{v}" for v in values)
    )


def month_ladders(
    df: DataFrame, node: str, date: str, columns: Sequence[str], rungs: int = RUNGS
) -> DataFrame:
    """Percentile ladder of each column per node and calendar month, packed in an array.

    A node has one row per day, so a group holds at most 31 rows per year of record.
    """
    month = F.month(date).alias("month")
    long = df.select(
        node,
        month,
        F.explode(
            F.array(
                *(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)
            )
        ).alias("cv"),
    ).select(node, "month", "cv.column", "cv.value")
    return bounded_ladder(long, [node, "month", "column"], F.col("value"), rungs)


def ladder_rows(ladders: DataFrame, rungs: int = RUNGS) -> DataFrame:
    """The packed ladders as one row per rung (percent)."""
    keys = [c for c in ladders.columns if c != "ladder"]
    return ladders.select(*keys, F.posexplode("ladder").alias("_i", "value")).select(
        *keys, (F.col("_i") * F.lit(100.0 / (rungs - 1))).alias("rung"), "value"
    )


def paired_ladders(cached: DataFrame, served: DataFrame, node: str) -> DataFrame:
    """Both sources' ladders per node, month and column, as one knot array served -> cached."""
    keys = [node, "month", "column"]
    joined = served.withColumnRenamed("ladder", "_x").join(
        cached.withColumnRenamed("ladder", "_y"), keys
    )
    points = F.transform(
        F.arrays_zip("_x", "_y"), lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y"))
    )
    return joined.select(*keys, strictly_rising(points).alias("knots"))


def require_all_months(ladders: DataFrame) -> DataFrame:
    """Months of the year no ladder covers; empty when the map may be shipped."""
    all_months = ladders.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return all_months.join(ladders.select("month").distinct(), "month", "left_anti")


def anomaly_knots(ladders: DataFrame, node: str, rungs: int = RUNGS) -> DataFrame:
    """Ladders turned round: value -> percentile, flat stretches collapsed."""
    points = F.transform(
        "ladder",
        lambda v, i: F.struct(v.alias("x"), (i * F.lit(100.0 / (rungs - 1))).alias("y")),
    )
    return ladders.select(node, "month", "column", strictly_rising(points).alias("knots"))


def _attach_knots(
    df: DataFrame, knots: DataFrame, node: str, date: str, columns: Sequence[str]
) -> DataFrame:
    wide = knots.groupBy(node, "month").agg(
        *(F.max_by("knots", F.col("column") == c).alias(f"_k_{c}") for c in columns),
        *(F.bool_or(F.col("column") == c).alias(f"_h_{c}") for c in columns),
    )
    return df.withColumn("month", F.month(date)).join(wide, [node, "month"], "left")


def map_quantiles(
    df: DataFrame,
    knots: DataFrame,
    node: str,
    date: str,
    columns: Sequence[str],
    ordered: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Read each value into its own cell-month's served ladder and out of the cached one.

    A cell-month without a ladder stays as it is. `ordered` names (maximum, mean) pairs whose
    maximum is lifted to the mean afterwards.
    """
    joined = _attach_knots(df, knots, node, date, columns)
    mapped = {
        c: F.when(F.col(f"_h_{c}"), interpolate(F.col(c).cast("double"), F.col(f"_k_{c}"))).otherwise(
            F.col(c)
        )
        for c in columns
    }
    out = joined.withColumns(mapped)
    out = out.withColumns({high: F.greatest(high, mean) for high, mean in ordered})
    return out.select(*df.columns)


def attach_anomalies(
    df: DataFrame, knots: DataFrame, node: str, date: str, columns: Sequence[str], suffix="_anom"
) -> DataFrame:
    """Each value's percentile in its own cell-month; 50 where the normals are flat."""
    joined = _attach_knots(df, knots, node, date, columns)
    placed = {}
    for c in columns:
        points = F.col(f"_k_{c}")
        value = F.col(c).cast("double")
        placed[f"{c}{suffix}"] = F.when(
            F.col(f"_h_{c}"),
            F.when(F.size(points) < 2, F.lit(50.0)).otherwise(interpolate(value, points)),
        ).cast("float")
    return joined.withColumns(placed).select(*df.columns, *placed)


def lapse_offsets(
    weights: DataFrame,
    heights: DataFrame,
    cells: DataFrame,
    cell: str = "cell_id",
    node: str = "era5_id",
    rate: float = 6.5,
) -> DataFrame:
    """One offset per cell from its own height and the interpolated backbone height."""
    backbone = (
        weights.join(heights, node)
        .groupBy(cell)
        .agg(F.sum(F.col("height") * F.col("weight")).alias("_height"))
    )
    joined = join_to_one(backbone, cells, [cell])
    known = F.when(
        F.col("elevation").isNull(), F.raise_error(F.lit("a weighted cell has no elevation"))
    ).otherwise(lapse_offset(F.col("elevation"), F.col("_height"), rate))
    return joined.select(cell, known.cast("double").alias("lapse_offset_k"))


def offsets_outside(offsets: DataFrame, rungs: Sequence[float]) -> DataFrame:
    """Offsets the rungs do not bracket; nothing may be extrapolated from them."""
    return offsets.where(~F.col("lapse_offset_k").between(float(rungs[0]), float(rungs[-1])))
