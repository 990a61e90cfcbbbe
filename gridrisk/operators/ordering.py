"""Order statistics that never put a whole group into one task.

A window without a partition, or over one hot group, sorts everything in a single task. The input
is collapsed to one row per value first and written out once. While every group stays under
`SLICE_ROWS` values a plain window does; beyond that the values of a group are cut into slices by
value, and slices that are still too large are cut again, until each is ordered on its own and
joined with the running totals of the slices before. The cut values are a sample picked by the
hash of the value itself, so a task that is run again cuts in the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.session import cut_lineage

# a group with fewer values than this is ordered in one piece
SLICE_ROWS = 1_000_000
# expected number of slices of a larger group or slice; the array of cuts stays this small
SLICES = 256
# numbers a slice has for the slices it is cut into, more than the sample ever picks
PARTS = 1024

ALL = "_all"


def _by(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key stands for 'no groups', so both cases take the same path."""
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a NULL key being a group like any other; the left side's keys remain."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*(f"_right_{k}" for k in keys))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group: one number, from counts combined before the shuffle."""
    if not by:
        return df.count()
    top = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return int(top or 0)


def slice_values(df: DataFrame, by: Sequence[str], order: str, slice_rows: int) -> DataFrame:
    """Add `_slice`, rising with `order` inside each group; 0 everywhere in a small group.

    `df` holds one row per group and value. Every round cuts what is still larger than a slice may
    be into some `SLICES` parts, so the largest slice is bounded whatever the group.
    """
    keys = [*by, "_slice"]
    sliced = df.withColumn("_slice", F.lit(0).cast("bigint"))
    while True:
        sizes = sliced.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows)
        # fewer than rows / slice_rows; written, so that joins know how small it is
        sizes = cut_lineage(sizes, "large-slices")
        if sizes.isEmpty():
            return sliced
        parts = F.least(F.lit(SLICES), F.ceil(F.col("_n") * 4 / slice_rows))
        picked = F.pmod(F.xxhash64(F.col(order), F.col("_slice")), F.col("_n")) < parts
        cuts = (
            meet(sliced.select(*keys, order), sizes, keys)
            .where(picked)
            .groupBy(*keys)
            .agg(F.slice(F.sort_array(F.collect_set(order)), 1, PARTS - 1).alias("_cuts"))
        )
        below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
        cut = meet(sliced, cut_lineage(cuts, "slice-cuts"), keys, "left")
        inner = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)
        sliced = cut_lineage(cut.withColumn("_slice", F.col("_slice") * PARTS + inner).drop("_cuts"), "sliced")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Sequence[str],
    slice_rows: int = SLICE_ROWS,
    with_next: bool = False,
) -> DataFrame:
    """Add `cum_<c>` (up to and including the row) and `total_<c>` for each summed column.

    `df` holds one row per group and value of `order`. With `with_next`, also `_next`, the value
    that follows in the group.
    """
    staged = cut_lineage(df, "ordered")
    keyed, keys = _by(staged, by)
    if largest_group(staged, by) <= slice_rows:
        out = _running_whole(keyed, keys, order, sums, with_next)
    else:
        out = _running_sliced(keyed, keys, order, sums, slice_rows, with_next)
    return out if by else out.drop(ALL)


def _running_whole(keyed, keys, order, sums, with_next):
    group = Window.partitionBy(*keys).orderBy(order)
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = {f"cum_{c}": F.sum(c).over(upto) for c in sums}
    columns |= {f"total_{c}": F.sum(c).over(through) for c in sums}
    if with_next:
        columns["_next"] = F.lead(order).over(group)
    return keyed.withColumns(columns)


def _running_sliced(keyed, keys, order, sums, slice_rows, with_next):
    sliced = slice_values(keyed, keys, order, slice_rows)
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumns({f"_in_{c}": F.sum(c).over(upto) for c in sums})
    if with_next:
        local = local.withColumn("_next", F.lead(order).over(inside))

    # one row a slice from here on
    pieces = sliced.groupBy(*keys, "_slice").agg(
        *(F.sum(c).alias(f"_t_{c}") for c in sums), F.min(order).alias("_first")
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *keys,
        "_slice",
        *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums),
        *(F.sum(f"_t_{c}").over(Window.partitionBy(*keys)).alias(f"total_{c}") for c in sums),
        F.lead("_first").over(along).alias("_after"),
    )
    out = meet(local, offsets, [*keys, "_slice"]).withColumns(
        {f"cum_{c}": F.col(f"_in_{c}") + F.col(f"_off_{c}") for c in sums}
    )
    if with_next:
        out = out.withColumn("_next", F.coalesce("_next", "_after"))
    spent = ["_slice", "_after", *(f"_in_{c}" for c in sums), *(f"_off_{c}" for c in sums)]
    return out.drop(*spent)


def running_max(
    df: DataFrame, by: Sequence[str], order: str, value: str, out: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Highest value up to each row, in the same slices."""
    staged = cut_lineage(df, "ordered")
    keyed, keys = _by(staged, by)
    rows = (Window.unboundedPreceding, Window.currentRow)
    if largest_group(staged, by) <= slice_rows:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(*rows)
        topped = keyed.withColumn(out, F.max(value).over(whole))
        return topped if by else topped.drop(ALL)
    sliced = slice_values(keyed, keys, order, slice_rows)
    upto = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(*rows)
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    tops = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_slice", F.max("_top").over(before).alias("_before"))
    )
    return (
        meet(sliced.withColumn("_in", F.max(value).over(upto)), tops, [*keys, "_slice"])
        .withColumn(out, F.greatest("_in", "_before"))
        .drop("_in", "_before", "_slice", *([] if by else [ALL]))
    )


def percentile_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Share of the group at or below the row's value, ties sharing their mean rank.

    NULL values get no rank and do not count. Small groups are ranked by one window; with a large
    one, distinct values are ranked in slices and joined back.
    """
    if largest_group(df, by) <= slice_rows:
        keyed, keys = _by(df, by)
        group = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
        ties = F.count(value).over(group.rangeBetween(Window.currentRow, Window.currentRow))
        known = F.count(value).over(
            group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        share = (F.rank().over(group) + (ties - 1) / 2.0) / known
        ranked = keyed.withColumn(out, F.when(F.col(value).isNotNull(), share))
        return ranked.select(*df.columns, out)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_ties"))
    )
    placed = running_sums(counts, by, value, ["_ties"], slice_rows)
    share = (F.col("cum__ties") - F.col("_ties") + (F.col("_ties") + 1) / 2.0) / F.col(
        "total__ties"
    )
    lookup = placed.select(*by, value, share.alias(out))
    return meet(df, lookup, [*by, value], "left").select(*df.columns, out)


def row_ids(
    df: DataFrame, order: Sequence[Column], out: str, start: int = 0, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Consecutive ids over the whole table in a total order, without one global sort task.

    The order columns have to tell every row apart.
    """
    keyed = df.withColumn("_order", F.struct(*order)).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_sums(keyed, (), "_order", ["_one"], slice_rows)
    return placed.withColumn(out, F.col("cum__one") - 1 + F.lit(start)).select(*df.columns, out)


def exact_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float] | None = None,
    rungs: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Linearly interpolated percentiles of any group size, one row per group and probability.

    Either a list of probabilities or `rungs` evenly spaced ones from 0 to 1. Columns: the
    group, `rung` (0-based position in the list), `value`.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_ties"))
    )
    placed = running_sums(counts, by, value, ["_ties"], slice_rows, with_next=True)
    n1 = F.col("total__ties") - 1
    first, after = F.col("cum__ties") - F.col("_ties"), F.col("cum__ties")
    # the value covers positions first..after-1, and up to the next value from there
    if rungs is not None:
        steps = F.lit(rungs - 1).cast("bigint")
        low = F.ceil(first * steps / F.greatest(n1, F.lit(1)))
        span = F.when(n1 == 0, F.sequence(F.lit(0), F.lit(rungs - 1))).otherwise(
            F.filter(
                F.sequence(
                    F.greatest(low.cast("int") - 1, F.lit(0)),
                    F.least(
                        F.ceil(after * steps / F.greatest(n1, F.lit(1))).cast("int") + 1,
                        F.lit(rungs - 1),
                    ),
                ),
                lambda i: (i * n1 >= first * steps) & (i * n1 < after * steps),
            )
        )
        position = F.col("rung") * n1 / steps
    else:
        probs = F.array(*(F.lit(float(p)) for p in probabilities))
        span = F.filter(
            F.sequence(F.lit(0), F.lit(len(probabilities) - 1)),
            lambda i: (F.get(probs, i) * n1 >= first) & (F.get(probs, i) * n1 < after),
        )
        position = F.get(probs, F.col("rung")) * n1
    part = F.greatest(position - (after - 1), F.lit(0.0))
    blended = F.when(
        part > 0, F.col(value) + part * (F.col("_next") - F.col(value))
    ).otherwise(F.col(value))
    return placed.withColumn("rung", F.explode(span)).select(
        *by, "rung", blended.cast("double").alias("value")
    )


def ladder(
    df: DataFrame, by: Sequence[str], value: str, rungs: int, out: str = "ladder"
) -> DataFrame:
    """Evenly spaced exact percentiles packed into one array per group."""
    steps = exact_percentiles(df, by, value, rungs=rungs)
    packed = F.transform(
        F.sort_array(F.collect_list(F.struct("rung", "value"))), lambda s: s["value"]
    )
    return steps.groupBy(*by).agg(packed.alias(out))


def bounded_ladder(
    df: DataFrame, by: Sequence[str], value: Column, rungs: int, out: str = "ladder"
) -> DataFrame:
    """The same for groups whose size the data bounds, such as the days of one cell-month.

    `percentile` holds a group's value counts in one task, so this is for cell-months only: a
    cell has one row per day, so at most 31 rows per year of record.
    """
    levels = F.array(*(F.lit(i / (rungs - 1)) for i in range(rungs)))
    usable = F.when(~F.isnan(value), value)
    return (
        df.groupBy(*by)
        .agg(F.percentile(usable, levels).alias(out))
        .where(F.col(out).isNotNull())
    )
