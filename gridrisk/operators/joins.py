"""Joins with their arity stated, as-of joins and weighted interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class JoinContractError(ValueError):
    """A key that should be unique is not."""


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate, one row by construction, to every row."""
    return (
        df.withColumn("_k", F.lit(0))
        .join(F.broadcast(one_row.withColumn("_k", F.lit(0))), "_k", "left")
        .drop("_k")
    )


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def join_to_one(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    check: bool = False,
) -> DataFrame:
    """Many-to-one join: a repeated right key is an error, never a multiplied row.

    The error is raised by the job itself: the right side carries the count of its key and a row
    with more than one fails. `check` looks before joining instead.
    """
    on = list(on)
    if check:
        repeated = duplicate_keys(right, on).limit(1).count()
        if repeated:
            raise JoinContractError(f"the right side repeats a key of {on}")
        return left.join(right, on, how)
    payload = [c for c in right.columns if c not in on]
    single = right.groupBy(*on).agg(
        F.count("*").alias("_copies"), *(F.any_value(c).alias(c) for c in payload)
    )
    guarded = single.where(
        F.when(
            F.col("_copies") > 1,
            F.raise_error(F.lit(f"the right side repeats a key of {on}")).cast("boolean"),
        ).otherwise(F.lit(True))
    ).drop("_copies")
    return left.join(guarded, on, how).select(*left.columns, *payload)


def join_one_to_one(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Both sides keep to one row per key."""
    payload = [c for c in left.columns if c not in on]
    marked = left.groupBy(*on).agg(
        F.count("*").alias("_copies"), *(F.any_value(c).alias(c) for c in payload)
    )
    guarded = marked.where(
        F.when(
            F.col("_copies") > 1,
            F.raise_error(F.lit(f"the left side repeats a key of {list(on)}")).cast("boolean"),
        ).otherwise(F.lit(True))
    ).drop("_copies")
    return join_to_one(guarded, right, on, how)


def nearest_edition(year: Column, editions: Sequence[int]) -> Column:
    """The edition nearest in time, the earlier one on a tie; editions are a short fixed list."""
    ranked = F.array(
        *(
            F.struct(F.abs(year - F.lit(e)).alias("gap"), F.lit(e).alias("edition"))
            for e in sorted(editions)
        )
    )
    return F.when(year.isNotNull(), F.array_min(ranked)["edition"]).cast("smallint")


def edition_join(
    left: DataFrame, editions: DataFrame, key: Sequence[str], edition: str, year: Column,
    known: Sequence[int],
) -> DataFrame:
    tagged = left.withColumn(edition, nearest_edition(year, known))
    return join_to_one(tagged, editions, [*key, edition])


def preceding_join(
    left: DataFrame,
    composites: DataFrame,
    key: Sequence[str],
    date: str,
    month: str,
    out: str = "composite_month",
) -> DataFrame:
    """Attach the last composite strictly before the month of each row.

    The months that exist form a table with a row per month of record, so finding the month is a
    bounded broadcast; the values then come by an equi-join on the key and that month.
    """
    months = composites.select(F.trunc(month, "month").alias("_m")).distinct()
    order = Window.orderBy("_m")
    # each month serves the dates after it up to the end of the next month that exists; the
    # unpartitioned window is over one row per month of the record
    spans = months.select(
        F.col("_m").alias(out),
        F.add_months("_m", 1).alias("_from"),
        F.coalesce(F.lead("_m").over(order), F.lit("2199-12-01").cast("date")).alias("_to"),
    )
    served = spans.select(
        out,
        F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("_own"),
    )
    placed = (
        left.withColumn("_own", F.trunc(date, "month"))
        .join(F.broadcast(served), "_own", "left")
        .drop("_own")
    )
    values = composites.withColumn(out, F.trunc(month, "month")).drop(month)
    return join_to_one(placed, values, [*key, out])


def clamped_join(
    left: DataFrame, table: DataFrame, key: Sequence[str], value: Column, clamp: str
) -> DataFrame:
    """Equi-join on a value held at the last one the table has."""
    last = table.agg(F.max(clamp).alias("_last"))
    clamped = with_scalars(left, last).withColumn(clamp, F.least(value, F.col("_last")))
    return join_to_one(clamped.drop("_last"), table, [*key, clamp])


def interpolate(
    samples: DataFrame,
    weights: DataFrame,
    backbone: DataFrame,
    columns: Sequence[str],
    row_key: Sequence[str],
    cell: str = "cell_id",
    node: str = "era5_id",
    date: str = "date",
    tolerance: float = 1e-6,
) -> DataFrame:
    """Weighted mean of the backbone at each sample's cell and day, as float32.

    One NULL in any column of any neighbour nulls the whole row; weights that do not sum to 1
    fail the job.
    """
    keys = list(dict.fromkeys([*row_key, cell, date]))
    pairs = samples.select(*keys).join(weights, cell, "left")
    joined = pairs.join(backbone.select(node, date, *columns), [node, date], "left")
    whole = F.bool_and(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    sums = joined.groupBy(*row_key).agg(
        F.sum("weight").alias("_mass"),
        whole.alias("_whole"),
        *(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns),
    )
    off = F.abs(F.coalesce(F.col("_mass"), F.lit(0.0)) - 1.0) > tolerance
    checked = sums.where(
        F.when(
            off, F.raise_error(F.lit("interpolation weights do not sum to 1")).cast("boolean")
        ).otherwise(F.lit(True))
    )
    return checked.select(
        *row_key, *(F.when(F.col("_whole"), F.col(c)).cast("float").alias(c) for c in columns)
    )


def interpolate_partial(
    samples: DataFrame,
    weights: DataFrame,
    backbone: DataFrame,
    columns: Sequence[str],
    row_key: Sequence[str],
    cell: str = "cell_id",
    node: str = "era5_id",
    date: str = "date",
    fill: float | None = None,
) -> DataFrame:
    """The same, with missing neighbours left out of the sum: NULL, or `fill`, if all are."""
    keys = list(dict.fromkeys([*row_key, cell, date]))
    joined = (
        samples.select(*keys)
        .join(weights, cell, "left")
        .join(backbone.select(node, date, *columns), [node, date], "left")
    )
    out = []
    for c in columns:
        total = F.sum(F.col("weight") * F.col(c))
        out.append((total if fill is None else F.coalesce(total, F.lit(fill))).alias(c))
    return joined.groupBy(*row_key).agg(*out)


def heaviest_neighbour(
    weights: DataFrame, cell: str = "cell_id", node: str = "era5_id"
) -> DataFrame:
    """The node each cell leans on most, the lowest id on a tie."""
    best = F.min_by(F.col(node), F.struct(-F.col("weight"), F.col(node)))
    return weights.groupBy(cell).agg(best.alias(node))


def reindex(
    spine: DataFrame, values: DataFrame, on: Sequence[str], fill: dict[str, float]
) -> DataFrame:
    """Every row of the spine, missing values filled."""
    return spine.join(values, list(on), "left").fillna(fill)


def off_grid(values: DataFrame, spine: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the spine does not know."""
    return values.join(spine, list(on), "left_anti")


def table_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table the other lacks, counting copies, with the side they are on."""
    missing = left.exceptAll(right).withColumn("side", F.lit("left"))
    extra = right.exceptAll(left).withColumn("side", F.lit("right"))
    return missing.unionByName(extra)


def column_mismatches(
    left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str], tolerance: float
) -> DataFrame:
    """Per column, how many joined rows differ by more than the tolerance, NULLs included."""
    joined = left.alias("a").join(right.alias("b"), list(on))
    flags = []
    for c in columns:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        far = F.coalesce(F.abs(a - b) > tolerance, F.lit(False)) | (a.isNull() != b.isNull())
        flags.append(F.struct(F.lit(c).alias("column"), far.alias("far")))
    long = joined.select(F.explode(F.array(*flags)).alias("f"))
    return long.groupBy(F.col("f.column").alias("column")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("f.far")).alias("mismatches")
    )
