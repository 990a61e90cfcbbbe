"""Bootstrap resamples drawn on classes of equal rows, all resamples in one pass over the classes.

Drawing rows with replacement gives every class of n equal rows a number of copies that is close
to Poisson distributed with mean n. The number is the Poisson quantile of one uniform per class and
resample, and the uniforms come from a pairwise independent family of hashes of the class: a task
makes those of a slice of classes as one matrix, and no row is written once per resample.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.hashing import draw_key
from gridrisk.session import cut_lineage

RESAMPLES = 1000
#: Hashes are linear functions modulo this prime.
PRIME = (1 << 31) - 1
#: Classes of a slice; a slice's matrix has a row a class and a column a resample.
SLICE = 2048


def class_hash(seed: int, *parts: Column) -> Column:
    """Where a class stands modulo the prime."""
    return F.pmod(draw_key(seed, *parts), F.lit(PRIME))


def coefficients(resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and addend of each resample's hash, as `draw_key` makes them."""

    def drawn(name: str, k: int) -> int:
        return int(hashlib.md5(f"{seed}|{name}|{k}".encode()).hexdigest()[:15], 16)

    factor = [1 + drawn("factor", k) % (PRIME - 1) for k in range(resamples)]
    return np.array(factor, np.int64), np.array([drawn("addend", k) % PRIME for k in range(resamples)], np.int64)


@cache
def poisson_steps(mean: int) -> tuple[int, np.ndarray]:
    """First count of weight and the cumulative probabilities from it on, to beyond double precision."""
    reach = 12.0 * math.sqrt(mean) + 40.0
    counts = np.arange(max(0, int(mean - reach)), int(mean + reach) + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(counts[1:]))]) + math.lgamma(counts[0] + 1)
    return int(counts[0]), np.cumsum(np.exp(counts * math.log(mean) - mean - logs))


def poisson_quantile(u: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The least count whose cumulative probability exceeds u, for rows of u with whole means."""
    out = np.zeros(u.shape, np.int64)
    for mean in np.unique(means):
        if mean > 0:
            rows = means == mean
            first, steps = poisson_steps(int(mean))
            out[rows] = first + np.searchsorted(steps, u[rows], "right")
    return out


def copies(place: np.ndarray, rows: np.ndarray, whole: bool, resamples: int, seed: int) -> np.ndarray:
    """Copies [class][resample]: of each row of a class on its own, or of whole clusters of rows."""
    factor, addend = _coefficients(resamples, seed)
    u = (place[:, None] * factor + addend) % PRIME / PRIME
    if whole:
        return poisson_quantile(u, np.ones_like(rows)) * rows[:, None]
    return poisson_quantile(u, rows)


_coefficients = cache(coefficients)


def _matrix(values: list) -> pa.Array:
    return pa.array([np.ascontiguousarray(v, np.int64).tobytes() for v in values], pa.binary())


def _read(raw: pa.Array, resamples: int) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), np.int64).reshape(-1, resamples) for v in raw]


def sliced(classes: DataFrame, measures: int, whole: bool, resamples: int, seed: int, slice_rows: int = SLICE) -> DataFrame:
    """Slices of the classes in the order of `at`, with how many copies stand before and in each.

    `classes` carry `at` and, for each measure k, the hash h<k> and the number of rows n<k>. One
    row a slice comes out, numbered by its place, with its classes as lists and `before`, `own` and
    `all`, matrices [measure][resample]. A value of `at` may span slices.
    """
    lists = ["at", *(f"{c}{k}" for k in range(measures) for c in "hn")]
    kinds = ", ".join(f"`{n}` array<{'double' if n == 'at' else 'bigint'}>" for n in lists)
    ordered = classes.select(F.col("at").cast("double").alias("at"), *(F.col(n).cast("bigint").alias(n) for n in lists[1:]))
    ordered = ordered.repartitionByRange("at", "h0").sortWithinPartitions("at", "h0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def row(part: pa.Table) -> pa.RecordBatch:
            own = [copies(part[f"h{k}"].to_numpy(), part[f"n{k}"].to_numpy(), whole, resamples, seed).sum(axis=0) for k in range(measures)]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([part[n].to_pylist()], pa.list_(part[n].type)) for n in lists), _matrix([np.stack(own)])], names=["slice", *lists, "own"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while len(rows) >= slice_rows:
                yield row(rows.slice(0, slice_rows).combine_chunks())
                number, rows = number + 1, rows.slice(slice_rows)
            held = rows
        if held is not None and len(held):
            yield row(held.combine_chunks())

    cuts = cut_lineage(ordered.mapInArrow(cut, f"slice bigint, {kinds}, own binary"), "bootstrap-slices")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((measures, resamples), np.int64)
        for batch in batches:
            before = []
            for own in _read(batch.column("own"), resamples):
                before.append(total)
                total = total + own
            yield pa.RecordBatch.from_arrays([batch.column("slice"), _matrix(before), pa.nulls(len(batch), pa.binary())], names=["slice", "before", "all"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.nulls(1, pa.binary()), _matrix([total])], names=["slice", "before", "all"])

    # one row a slice, a batch of them in memory at a time
    placed = cut_lineage(cuts.select("slice", "own").repartition(1).sortWithinPartitions("slice").mapInArrow(add_up, "slice bigint, before binary, all binary"), "bootstrap-sums")
    every = placed.where("slice = -1").select(F.col("all").alias("_all"))
    # one row
    return cuts.join(placed.where("slice >= 0").drop("all"), "slice").join(F.broadcast(every)).withColumnRenamed("_all", "all")


def _per_resample(slices: DataFrame, names: Sequence[str], make: Callable, resamples: int) -> DataFrame:
    """What `make` yields per slice, [name][resample] floats, added up in each task and then by resample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), resamples))
        for batch in batches:
            for k in range(len(batch)):
                total += make(batch.slice(k, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), *(pa.array(x) for x in total)], names=["replicate", *names])

    parts = slices.mapInArrow(run, "replicate int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("replicate").agg(*(F.sum(n).alias(n) for n in names))


def _column(row: pa.RecordBatch, name: str) -> np.ndarray:
    return row.column(name)[0].values.to_numpy(zero_copy_only=False)


def score_resamples(df: DataFrame, label: str, score: str, resamples: int = RESAMPLES, seed: int = 1, slice_rows: int = SLICE) -> DataFrame:
    """AP, AUROC and lift of every resample that holds both classes, one row per replicate.

    Rows collapse to distinct scores with their hits and misses first.
    """
    hit = F.col(label).cast("long")
    rows = df.groupBy((-F.col(score)).alias("at"), F.col(score).alias("_score")).agg(F.sum(1 - hit).alias("n0"), F.sum(hit).alias("n1"))
    rows = rows.select("at", "n0", "n1", class_hash(seed, F.lit(0), F.col("_score")).alias("h0"), class_hash(seed, F.lit(1), F.col("_score")).alias("h1"))
    # a score is one class of hits and one of misses, in one row, so none spans two slices
    slices = sliced(rows, 2, False, resamples, seed, slice_rows)

    def parts(row: pa.RecordBatch) -> np.ndarray:
        miss, hits = (copies(_column(row, f"h{k}"), _column(row, f"n{k}"), False, resamples, seed) for k in (0, 1))
        before = _read(row.column("before"), resamples)[0]
        cum_miss, cum_hits = before[0] + np.cumsum(miss, axis=0), before[1] + np.cumsum(hits, axis=0)
        seen = cum_miss + cum_hits
        precision = np.divide(hits * cum_hits, seen, out=np.zeros(seen.shape), where=seen > 0)
        # a positive loses to the negatives above it, and ties count half
        lost = hits * (cum_miss - miss / 2.0)
        return np.stack([precision.sum(axis=0), lost.sum(axis=0), hits.sum(axis=0), miss.sum(axis=0)])

    sums = _per_resample(slices, ["_precision", "_lost", "_hits", "_miss"], parts, resamples)
    p, q = F.col("_hits"), F.col("_miss")
    return sums.where((p > 0) & (q > 0)).select(
        "replicate",
        (F.col("_precision") / p).alias("auprc"),
        (1.0 - F.col("_lost") / (p * q)).alias("auroc"),
        (F.col("_precision") / p * (p + q) / p).alias("lift"),
    )


def cluster_medians(df: DataFrame, cluster: str, value: str, resamples: int = RESAMPLES, seed: int = 1, slice_rows: int = SLICE) -> DataFrame:
    """The median of every resample of whole clusters, one row per replicate that holds any.

    Copies are counted by slices of the values; a resample's middle ranks lie in one or two of
    them, and only there its copies are added up value by value.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("at"), cluster).agg(F.count("*").alias("n0"))
    rows = rows.select("at", "n0", class_hash(seed, F.col(cluster)).alias("h0"))
    slices = sliced(rows, 1, True, resamples, seed, slice_rows)

    def parts(row: pa.RecordBatch) -> np.ndarray:
        before, own, total = (_read(row.column(n), resamples)[0][0] for n in ("before", "own", "all"))
        out = np.zeros((2, resamples))
        low, high = (total - 1) // 2, total // 2
        here = np.flatnonzero((total > 0) & (own > 0) & (high >= before) & (low < before + own))
        if len(here):
            at = _column(row, "at")
            drawn = copies(_column(row, "h0"), _column(row, "n0"), True, resamples, seed)[:, here]
            upto = before[here] + np.cumsum(drawn, axis=0)
            for k, rank in enumerate((low[here], high[here])):
                inside = (rank >= before[here]) & (rank < before[here] + own[here])
                out[k, here] = np.where(inside, at[np.argmax(upto > rank, axis=0)], 0.0)
        return np.vstack([out, own[None, :]])

    sums = _per_resample(slices, ["_low", "_high", "_rows"], parts, resamples)
    return sums.where("_rows > 0").select("replicate", ((F.col("_low") + F.col("_high")) / 2.0).alias("median"))


def paired_median_gaps(df: DataFrame, cluster: str, reference: str, other: str, resamples: int = RESAMPLES, seed: int = 1) -> DataFrame:
    """Median of one column less that of another per replicate, both over the same resampled clusters."""
    base, changed = (cluster_medians(df, cluster, c, resamples, seed).withColumnRenamed("median", f"_{k}") for k, c in enumerate((reference, other)))
    return base.join(changed, "replicate").select("replicate", (F.col("_1") - F.col("_0")).alias("gap"))


def fixed_ratio_draws(df: DataFrame, label: str, score: str, ratio: int = 10, draws: int = 200, seed: int = 1, slice_rows: int = SLICE) -> DataFrame:
    """(draw, positives, negatives, auprc) of draws without replacement at exactly `ratio` negatives a positive.

    Whichever side is in excess is cut. How many of a draw's rows come from each slice of the
    classes, and within it from each class, follows the hypergeometric distribution, from a
    generator seeded by draw and slice, so the ratio is exact and no row is written once per draw.
    A table that cannot hold one positive at the ratio gives no rows.
    """
    hit = F.col(label).cast("long")
    rows = df.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("at")).agg(F.sum(1 - hit).alias("n0"), F.sum(hit).alias("n1"))
    placed = rows.select(F.col("at").cast("double").alias("at"), "n0", "n1").repartitionByRange("at").sortWithinPartitions("at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def row(part: pa.Table) -> pa.RecordBatch:
            lists = [pa.array([part[n].to_pylist()], pa.list_(pa.int64())) for n in ("n0", "n1")]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists], names=["slice", "n0", "n1"])

        for batch in batches:
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while len(now) >= slice_rows:
                yield row(now.slice(0, slice_rows).combine_chunks())
                number, now = number + 1, now.slice(slice_rows)
            held = now
        if held is not None and len(held):
            yield row(held.combine_chunks())

    slices = cut_lineage(placed.mapInArrow(cut, "slice bigint, n0 array<bigint>, n1 array<bigint>"), "ratio-slices")
    total = lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = slices.select("slice", total("n0").alias("n0"), total("n1").alias("n1"))
    negatives, positives = sizes.agg(F.sum("n0"), F.sum("n1")).first()
    kept = min(positives or 0, (negatives or 0) // ratio)
    schema = "draw int, positives bigint, negatives bigint, auprc double"
    if not kept:
        return df.sparkSession.createDataFrame([], schema)
    wanted = (kept * ratio, kept)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is still to be drawn, and from how many rows; one row a slice comes by
        left = [np.full(draws, w, np.int64) for w in wanted]
        rest = [negatives, positives]
        seen = np.zeros((2, draws), np.int64)
        sources = [np.random.default_rng([seed, k]) for k in range(draws)]
        for batch in batches:
            out: list[np.ndarray] = []
            before: list[np.ndarray] = []
            for sizes_ in zip(batch.column("n0").to_pylist(), batch.column("n1").to_pylist(), strict=True):
                taken = np.zeros((2, draws), np.int64)
                for side, n in enumerate(sizes_):
                    taken[side] = [s.hypergeometric(n, rest[side] - n, int(w)) if w else 0 for s, w in zip(sources, left[side], strict=True)]
                    rest[side] -= n
                    left[side] = left[side] - taken[side]
                before.append(seen)
                out.append(taken)
                seen = seen + taken
            yield pa.RecordBatch.from_arrays([batch.column("slice"), _matrix(before), _matrix(out)], names=["slice", "before", "own"])

    shares = cut_lineage(sizes.repartition(1).sortWithinPartitions("slice").mapInArrow(share, "slice bigint, before binary, own binary"), "ratio-shares")

    def parts(row: pa.RecordBatch) -> np.ndarray:
        before, own = (_read(row.column(n), draws)[0] for n in ("before", "own"))
        number = row.column("slice")[0].as_py()
        drawn = []
        for side in (0, 1):
            sizes_ = _column(row, f"n{side}")
            each = [np.random.default_rng([seed, number, side, k]).multivariate_hypergeometric(sizes_, int(w), method="marginals") for k, w in enumerate(own[side])]
            drawn.append(np.stack(each, axis=1))
        hits, seen = before[1] + np.cumsum(drawn[1], axis=0), before.sum(axis=0) + np.cumsum(drawn[0] + drawn[1], axis=0)
        precision = np.divide(drawn[1] * hits, seen, out=np.zeros(seen.shape), where=seen > 0)
        return np.stack([precision.sum(axis=0), own[1], own[0]])

    sums = _per_resample(slices.join(shares, "slice"), ["_precision", "_hits", "_miss"], parts, draws)
    return sums.select(F.col("replicate").alias("draw"), F.col("_hits").cast("long").alias("positives"), F.col("_miss").cast("long").alias("negatives"), (F.col("_precision") / F.col("_hits")).alias("auprc"))
