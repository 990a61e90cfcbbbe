"""Documents drawn towards a target distribution, ranked by a distributed radix sort.

Runs of words fall into a fixed number of buckets; a bucket's gain is the log ratio of its shares
in the target and in the corpus, kept as an array that every task scores its documents with.
Gumbel noise turns weights into a draw without replacement: the highest scores are drawn. The
order comes from a least-significant-digit radix sort over blocks of rows: each pass counts the
digits of every block, prefix offsets over (digit, block) give each row its place, and the row
goes to the block of that place.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.text import LOWER, chunks, column, numbered, place, words
from gridrisk.session import cut_lineage

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
DIGIT = 12  # bits of a pass
BLOCK = 1 << 16  # rows of a block

SHORT = 64  # bytes of a word up to which checksums are worked on in arrays


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


TABLE = _crc_table()


def _appended() -> np.ndarray:
    """[n][k][byte]: what byte k of a checksum becomes when n more bytes follow."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for n in range(SHORT + 1):
        out[n] = state
        state = (state >> np.uint32(8)) ^ TABLE[state & np.uint32(255)]
    return out


APPENDED = _appended()


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of strings put together, from both checksums and the size of the second, up to SHORT."""
    moved = APPENDED[size, 0, first & np.uint32(255)]
    for k in range(1, 4):
        moved ^= APPENDED[size, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return moved ^ second


def word_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, all ranges of a size at least k going on to byte k together."""
    size = end - begin
    out = np.zeros(len(begin), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT, "left"))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[begin[k] : end[k]].tobytes())
    order = order[long:]
    sizes, at = size[order], begin[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))
        state[:n] = (state[:n] >> np.uint32(8)) ^ TABLE[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)]
    out[order] = ~state
    return out


def buckets(data: np.ndarray, bounds: np.ndarray, most: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, buckets of the words, buckets of neighbouring words), rows in order.

    The pairs of a row are one less than its words.
    """
    begin, end, row, _ = words(data, bounds)
    lower = LOWER[data]
    one = word_crcs(lower, begin, end)
    left = np.flatnonzero(row[1:] == row[:-1])
    right = left + 1
    blank = np.uint32(zlib.crc32(b" "))
    spaced = joined_crc(one, np.full(len(one), blank), np.ones(len(one), np.int64))
    size = (end - begin)[right]
    two = joined_crc(spaced[left], one[right], np.minimum(size, SHORT))
    for k in np.flatnonzero(size > SHORT).tolist():
        two[k] = zlib.crc32(lower[begin[right[k]] : end[right[k]]].tobytes(), int(spaced[left[k]]))
    return np.bincount(row, minlength=len(bounds) - 1), one % np.uint32(most), two % np.uint32(most)


def bucket_counts(texts: DataFrame, text: str = "text", most: int = BUCKETS) -> dict[int, int]:
    """Features of all texts by bucket; at most as many numbers as there are buckets reach the driver."""
    rows = texts.select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(column(batch, "text")):
                _, one, two = buckets(data, bounds, most)
                total += np.bincount(one, minlength=most) + np.bincount(two, minlength=most)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], most: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the corpus."""
    s, t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + most) / ((corpus.get(b, 0) + 1) * (t + most)))) for b in range(most)], np.int64)


def noise(key: object, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the key alone; a null key is an empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score and where the row was read (block, pos) of each document."""
    rows = docs.select(key, text)
    base, key_at, at = numbered(rows), place(rows, key), place(rows, text)
    kind = base.schema[key_at].dataType.simpleString()
    most = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pos = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            keys = column(batch, key_at)
            for first, last, data, bounds in chunks(column(batch, at)):
                n, one, two = buckets(data, bounds, most)
                pairs = np.maximum(n - 1, 0)
                total = np.zeros(last - first, np.int64)
                for sizes, found in ((n, one), (pairs, two)):
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    ends = np.cumsum(sizes)
                    total += sums[ends] - sums[ends - sizes]
                features = n + pairs
                weight = total // np.maximum(features, 1)
                own = keys.slice(first, last - first)
                scores = weight + np.array([noise(k, seed) for k in own.to_pylist()], np.int64)
                places = pos + np.arange(last - first)
                pos += last - first
                yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(features), pa.array(weight), pa.array(scores), pa.array(block + places // BLOCK), pa.array(places % BLOCK)], names=["key", "n_words", "n_features", "weight", "score", "block", "pos"])

    return base.mapInArrow(score, f"key {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, block bigint, pos bigint")


def digit(high: np.ndarray, low: np.ndarray, low_bits: int, number: int, bits: int = DIGIT) -> np.ndarray:
    """Digit `number`, from the least significant one, of keys whose lower part has `low_bits` bits."""
    shift, mask = number * bits, np.uint64((1 << bits) - 1)
    if shift >= low_bits:
        return ((high >> np.uint64(shift - low_bits)) & mask).astype(np.int64)
    out = low >> np.uint64(shift)
    if shift + bits > low_bits:
        out = out | (high << np.uint64(low_bits - shift))
    return (out & mask).astype(np.int64)


def radix_ranked(rows: DataFrame, high: str, low: str, high_bits: int, low_bits: int, bits: int = DIGIT, block_rows: int = BLOCK) -> DataFrame:
    """The rows with `position` from 0 in the order of (high, low), two columns of unsigned longs.

    `block` and `pos` say where a row stands before; they are replaced. No task holds more than a
    block, and the offsets are sums over (digit, block). Rows of equal keys keep their order.
    """
    names = [n for n in rows.columns if n not in ("block", "pos")]
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + ", block bigint, pos bigint, _digit bigint, _index bigint"

    def numbered_digits(number: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            block = None

            def done() -> Iterator[pa.RecordBatch]:
                # rows of one block, in the order of pos
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    own = digit(*(column(whole, c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (high, low)), low_bits, number, bits)
                    order = np.argsort(own, kind="stable")
                    sizes = np.bincount(own, minlength=1 << bits)
                    index = np.empty(len(own), np.int64)
                    index[order] = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(own), pa.array(index)], names=[*whole.schema.names, "_digit", "_index"])
                    held.clear()

            for batch in batches:
                blocks = column(batch, "block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        if block != blocks[a]:
                            yield from done()
                        block = blocks[a]
                        held.append(batch.slice(a, b - a))
            yield from done()

        return count

    current = rows.select(*names, "block", "pos")
    passes = -(-(high_bits + low_bits) // bits)
    for number in range(passes):
        dealt = current.repartition("block").sortWithinPartitions("block", "pos")
        counted = cut_lineage(dealt.mapInArrow(numbered_digits(number), schema), "radix-pass")
        sizes = cut_lineage(counted.groupBy("_digit", "block").agg(F.count("*").alias("_n")), "radix-sizes")
        digits = sizes.groupBy("_digit").agg(F.sum("_n").alias("_all"))
        # one row a digit, at most 2 ^ bits of them
        below = digits.select("_digit", F.coalesce(F.sum("_all").over(Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
        earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select("_digit", "block", earlier.alias("_earlier")).join(below, "_digit").select("_digit", "block", (F.col("_earlier") + F.col("_below")).alias("_first"))
        placed = counted.join(offsets, ["_digit", "block"]).withColumn("position", F.col("_first") + F.col("_index"))
        current = placed.select(*names, F.floor(F.col("position") / block_rows).alias("block"), F.pmod("position", F.lit(block_rows)).alias("pos"))
    return current.select(*names, (F.col("block") * block_rows + F.col("pos")).alias("position"))


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, most: int = BUCKETS) -> DataFrame:
    """key, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with `least_words` words, floor(percent * N / 100) with the highest scores
    are drawn, ties going to the smaller key, a null key being the smallest. Null and empty texts
    have no features and weight 0. Rows that agree in key and score, such as repeated rows, have
    ranks of their own, in the order they are read. Empty tables give no rows. The key is a whole
    number; other columns are not read. A text is held whole by its task.
    """
    gain = gains(bucket_counts(docs, text, most), bucket_counts(target, text, most), most)
    rows = cut_lineage(scored(docs, gain, text, key, seed), "drawn-scores")
    able = rows.where(F.col("n_words") >= least_words)
    n, low, high, least, greatest = able.agg(F.count("*"), F.min("score"), F.max("score"), F.min(F.col("key").cast("long")), F.max(F.col("key").cast("long"))).first()
    most_drawn = percent * n // 100
    if not n:
        return rows.select(F.col("key").alias(key), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    # differences of longs as unsigned ones; a null key is 0, so others begin at 1
    least = 0 if least is None else least
    low_bits = ((greatest if greatest is not None else least) - least + 1).bit_length()
    if low_bits > 63:
        raise ValueError("the keys span more than 63 bits")
    keyed = able.select("key", "n_features", "weight", "score", "block", "pos", (F.lit(high) - F.col("score")).alias("_high"), F.coalesce(F.col("key").cast("long") - F.lit(least) + 1, F.lit(0)).cast("long").alias("_low"))
    ranked = radix_ranked(keyed, "_high", "_low", (high - low).bit_length(), low_bits)
    rank = F.when(F.col("position") < most_drawn, F.col("position") + 1).cast("long")
    rest = rows.where(F.col("n_words") < least_words).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("key", "n_features", "weight", "score", rank.alias("rank")).unionByName(rest).withColumnRenamed("key", key)


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return drawn(docs.select("doc_id", "text"), target)
