"""Top-k, keep-first and set operations with the order spelled out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.operators.ordering import row_ids


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Each task keeps its own k best; only those meet."""
    return df.orderBy(*order).limit(k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the smallest in `order`; combined before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_kept")
    return (
        df.groupBy(*keys)
        .agg(best)
        .select(*keys, *(F.col(f"_kept.{c}").alias(c) for c in rest))
        .select(*df.columns)
    )


def top_per_group(
    items: DataFrame,
    counts: DataFrame,
    group: str,
    item: str,
    score: str,
    wanted: str,
) -> DataFrame:
    """For each group its `wanted` best items of one global ranking.

    The ranking is made once over the items; a group then takes the ranks up to its count.
    """
    ranked = row_ids(items, [-F.col(score), F.col(item)], "rank", start=1)
    picks = counts.where(F.col(wanted) > 0).select(
        group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(wanted))).alias("rank")
    )
    return picks.join(ranked.select(item, score, "rank"), "rank").select(group, item, score, "rank")


def hits_in_top(
    events: DataFrame, flagged: DataFrame, items: DataFrame, score: str, cell: str = "cell_id"
) -> DataFrame:
    """Events whose cell ranks within as many top cells as their day flagged.

    Looks up the event's own rank, so the top cells of a day are never listed.
    """
    ranked = row_ids(items, [-F.col(score), F.col(cell)], "rank", start=1)
    joined = events.join(flagged, "date").join(ranked.select(cell, "rank"), cell)
    return joined.where(F.col("rank") <= F.col("flagged"))


#: Bins of a round of selection, and rows of a bin that are ordered in one piece.
BINS = 1024
ORDERED = 100_000


def _narrowed(df: DataFrame, value: str, hit: str, wanted: Mapping[int, tuple], ordered: int) -> dict[int, tuple]:
    """Brackets (low, high, rows before, hits before, rows) of values that hold wanted rows.

    `wanted` maps a target to its rank, counted from 1 by falling value, and the bracket it starts
    from. A round counts rows and hits of equal bins of every bracket in one pass; the bin that
    holds the rank, shrunk to the values that are there, is the next bracket. Brackets end at one
    value or at few rows; those of two targets are equal or apart.
    """
    found = dict(wanted)
    while True:
        open_ = sorted({b[:2] for _, b in found.values() if b[0] < b[1] and b[4] > ordered})
        if not open_:
            return found
        place = bin_ = None
        for k, (low, high) in enumerate(open_):
            inside = F.col(value).between(F.lit(low), F.lit(high))
            # rising with the value, however it is rounded
            share = (F.lit(high).cast("double") - F.col(value).cast("double")) / F.lit(float(high) - float(low))
            own = F.least(F.floor(share * BINS), F.lit(BINS - 1))
            place = F.when(inside, F.lit(k)) if place is None else place.when(inside, F.lit(k))
            bin_ = F.when(inside, own) if bin_ is None else bin_.when(inside, own)
        counts = (
            df.select(value, hit, place.alias("_place"), bin_.alias("_bin"))
            .where(F.col("_place").isNotNull())
            .groupBy("_place", "_bin")
            .agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.min(value).alias("low"), F.max(value).alias("high"))
        )
        # BINS rows a bracket at most
        rows = sorted(tuple(r) for r in counts.collect())
        for target, (rank, bracket) in found.items():
            if bracket[:2] not in open_:
                continue
            before, hits = bracket[2:4]
            for place_, _, n, own_hits, low, high in rows:
                if place_ == open_.index(bracket[:2]):
                    if before + n >= rank:
                        found[target] = (rank, (low, high, before, hits, n))
                        break
                    before, hits = before + n, hits + own_hits


def precision_at(
    scores: DataFrame,
    label: str,
    score: str,
    tie: str,
    fractions: Sequence[float],
    ordered: int = ORDERED,
) -> DataFrame:
    """Rows, hits, precision, recall and threshold over the top share of the ranking.

    k is rounded half to even and is at least 1; ties are taken in the order of `tie`, a number.
    Rows without a score do not count, and an empty table gives no rows. The ranking is never
    made: rounds of counts find the score of the k-th row, then its tie among the rows of that
    score, until few rows are left to order.
    """
    rows = scores.where(F.col(score).isNotNull()).select(
        F.col(score).alias("_score"), (-F.col(tie)).alias("_tie"), F.col(label).cast("bigint").alias("_hit")
    )
    total = rows.agg(
        F.count("*").alias("n"), F.sum("_hit").alias("hits"), F.min("_score").alias("low"), F.max("_score").alias("high"),
        *(F.greatest(F.lit(1), F.bround(F.lit(float(q)) * F.count("*"), 0).cast("bigint")).alias(f"k{i}") for i, q in enumerate(fractions)),
    ).first()
    spark = scores.sparkSession
    kind = scores.schema[score].dataType.simpleString()
    schema = f"fraction double, k bigint, caught bigint, precision double, recall double, threshold {kind}"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    start = (total["low"], total["high"], 0, 0, total["n"])
    by_score = _narrowed(rows, "_score", "_hit", {i: (total[f"k{i}"], start) for i in range(len(fractions))}, ordered)
    last: dict[int, tuple] = {}
    for low, high in sorted({b[:2] for _, b in by_score.values()}):
        own = {i: w for i, w in by_score.items() if w[1][:2] == (low, high)}
        among = rows.where(F.col("_score").between(F.lit(low), F.lit(high)))
        if low == high and next(iter(own.values()))[1][4] > ordered:
            # many rows of one score: the same by their ties
            ends = among.agg(F.min("_tie"), F.max("_tie")).first()
            own = {i: (rank, (*ends, *b[2:])) for i, (rank, b) in own.items()}
            own = _narrowed(among, "_tie", "_hit", own, ordered)
            for first, end in sorted({b[:2] for _, b in own.values()}):
                some = {i: w for i, w in own.items() if w[1][:2] == (first, end)}
                last.update(_placed(among.where(F.col("_tie").between(F.lit(first), F.lit(end))), some))
        else:
            last.update(_placed(among, own))
    out = []
    for i, q in enumerate(fractions):
        k, (caught, threshold) = total[f"k{i}"], last[i]
        out.append((float(q), k, caught, caught / k, caught / total["hits"] if total["hits"] else None, threshold))
    return spark.createDataFrame(out, schema)


def _placed(rows: DataFrame, wanted: Mapping[int, tuple]) -> dict[int, tuple]:
    """Hits up to the wanted ranks, and their scores, from the few rows of a bracket."""
    before, hits = next(iter(wanted.values()))[1][2:4]
    order = Window.orderBy(F.desc("_score"), F.desc("_tie"))
    ranked = rows.withColumns({"_k": F.row_number().over(order) + F.lit(before), "_upto": F.sum("_hit").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(hits)})
    ranks = {rank: i for i, (rank, _) in wanted.items()}
    found = {r["_k"]: (r["_upto"], r["_score"]) for r in ranked.where(F.col("_k").isin(list(ranks))).collect()}
    return {i: found[rank] for i, (rank, _) in wanted.items()}


def best_of(df: DataFrame, groups: Sequence[str], item: str, value: str) -> DataFrame:
    """The item with the highest value, the first item on a tie."""
    best = F.max_by(F.col(item), F.struct(F.col(value), -F.col(item)))
    return df.groupBy(*groups).agg(best.alias(item), F.max(value).alias(value))


def union_all(blocks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), blocks)


def labelled_union(blocks: Mapping[str, DataFrame], out: str) -> DataFrame:
    return union_all([frame.withColumn(out, F.lit(name)) for name, frame in blocks.items()])


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left side only, of the right side only, and of both."""
    return union_all(
        [
            left.subtract(right).withColumn("side", F.lit("left")),
            right.subtract(left).withColumn("side", F.lit("right")),
            left.intersect(right).withColumn("side", F.lit("both")),
        ]
    )


def membership(groups: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Every key of any group once, with a flag per group."""
    tagged = labelled_union({n: f.select(key) for n, f in groups.items()}, "_group")
    return tagged.groupBy(key).agg(
        *(F.bool_or(F.col("_group") == n).alias(f"in_{n}") for n in groups)
    )
