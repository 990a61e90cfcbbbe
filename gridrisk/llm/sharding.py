"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, by column functions.

Rows get dense numbers without a single ordered task: equal rows are counted together, the groups
fall into hash buckets, and running counts within buckets add to running counts over buckets. The
permutation then gives each number its place in the shuffle, and from it shard and slot follow by
arithmetic, for any row and in either direction.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.session import cut_lineage

SHARDS = 40
SEED = 20_240_607
ROUNDS = 6
BUCKET_ROWS = 50_000
RUN = 100_000  # equal rows written out at once
OVERHEAD = 16  # bytes a row takes besides its text


def domain(n: int, tries: int = 20_000) -> tuple[int, int]:
    """(a, b) with a * b >= n and as few places beyond n as a search near the square root finds."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return min(((x, max(1, -(-n // x))) for x in range(a, a + min(tries, a) + 1)), key=lambda d: d[0] * d[1])


def permuted_once(value: Column, a: int, b: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One application of the Feistel network on 0 to a * b - 1: halves in turn are shifted by a hash of the other."""

    def step(k: int, halves: Column) -> Column:
        left, right = halves["l"], halves["r"]
        if k % 2 == 0:
            return F.struct(F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(k)), F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))
        return F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(k)), F.lit(b)), F.lit(b)).alias("r"))

    halves = F.struct(((value - F.pmod(value, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).alias("r"))
    current = F.array(halves)
    for k in range(rounds):
        current = F.transform(current, lambda halves: step(k, halves))  # noqa: B023, the body runs at once
    return current[0]["l"] * F.lit(b) + current[0]["r"]


def permuted(value: Column, n: int, seed: int = SEED) -> Column:
    """Where row number `value` of n rows stands in the shuffle, from 0 to n - 1.

    Cycle walking: a place beyond n is permuted again. A walk meets each of the places beyond n
    once at most, so as many steps as there are such places always end it.
    """
    a, b = domain(n)
    beyond = a * b - n
    first = permuted_once(value, a, b, seed)
    if not beyond:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), first, lambda at, _: F.when(at < n, at).otherwise(permuted_once(at, a, b, seed)))


def placed(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The key columns of every row with row_number, position, shard and slot.

    Shards differ by one row at most and slots run from 0 without a gap. The result depends on the
    rows alone, not on how they are partitioned. Nulls are a value like others; equal rows get
    places of their own, in no order among them; an empty table gives an empty one.
    """
    groups = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_copies")), "shard-rows")
    n, kinds = groups.agg(F.sum("_copies"), F.count("*")).first()
    n, buckets = n or 0, max(1, -(-kinds // BUCKET_ROWS))
    bucketed = groups.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    totals = bucketed.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    # a row a bucket; written, so that the join knows how small it is
    before = cut_lineage(totals.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "shard-buckets")
    within = F.coalesce(F.sum("_copies").over(Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = bucketed.withColumn("_within", within).join(before, "_bucket").withColumn("_first", F.col("_before") + F.col("_within"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN))))
    each = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, F.col("_copies")) - 1)))
    numbered = each.withColumn("row_number", F.col("_first") + F.col("_copy")).withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    return numbered.select(*keys, "row_number", "position", F.pmod("position", F.lit(shards)).cast("int").alias("shard"), ((F.col("position") - F.pmod("position", F.lit(shards))) / shards).cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD
    rows = docs.select("doc_id", size.cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    found = placed(rows, ["doc_id", "size", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
