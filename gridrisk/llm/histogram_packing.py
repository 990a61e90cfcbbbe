"""Best-fit packing planned on the histogram of lengths: documents only take slots of the plan.

Every task counts its pieces by length and numbers those of a length; the histogram has a row a
length, whatever the corpus. Best fit decreasing runs over its counts: sequences that are filled
alike form one group, and one step places all pieces of a length that fit the group. A piece
finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.encoding import encoded
from gridrisk.llm.text import column, numbered, place
from gridrisk.session import cut_lineage

TOKENS = 2048
END = 1  # the id after each document
SHARD = 1 << 21  # pieces of a task that are ranked together


@dataclass
class Plan:
    """Runs of slots: `count` pieces of `length` from rank `rank` on, `each` to a sequence.

    The first of them stands at `offset` in sequence `sequence`, those after it in the same one
    behind it, and the next `each` in the next sequence.
    """

    limit: int
    sequences: int = 0
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def add(self, *run: int) -> None:
        for name, value in zip(("length", "rank", "count", "each", "sequence", "offset"), run, strict=True):
            getattr(self, name).append(value)


def best_fit(counts: Mapping[int, int], limit: int = TOKENS) -> Plan:
    """Best fit decreasing over the counts of lengths from 1 to `limit`.

    The longest pieces come first; each goes to the fullest sequence that has room, and opens one
    if none has. Sequences with the same room whose numbers follow each other are one group, so the
    work and the plan depend on the number of lengths, not on the counts: a length ends at most
    one group halfway and opens at most two.
    """
    plan = Plan(limit)
    room: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), least room first

    def fill(length: int, rank: int, left: int, space: int, first: int, size: int) -> int:
        """Place pieces into a group of sequences; how many went in."""
        each = space // length
        placed = min(left, each * size)
        full, rest = divmod(placed, each)
        for number, sequences, pieces in ((first, full, each), (first + full, 1 if rest else 0, rest)):
            if sequences:
                plan.add(length, rank, sequences * pieces, pieces, number, limit - space)
                rank += sequences * pieces
                if space - pieces * length:
                    insort(room, (space - pieces * length, number, sequences))
        untouched = first + full + (1 if rest else 0)
        if untouched < first + size:
            insort(room, (space, untouched, first + size - untouched))
        return placed

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(room, (length, -1, 0))
            if at < len(room):
                space, first, size = room.pop(at)
            else:
                space, size = limit, -(-left // (limit // length))
                first = plan.sequences
                plan.sequences += size
            done = fill(length, rank, left, space, first, size)
            rank, left = rank + done, left - done
    return plan


def slots(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    runs = [np.array(x, np.int64) for x in (plan.length, plan.rank, plan.each, plan.sequence, plan.offset)]
    order = np.lexsort((runs[1], runs[0]))
    lengths, ranks, each, sequence, offset = (x[order] for x in runs)
    # runs of one length are told apart by their place among them
    shift = np.int64(max(int(ranks.max(initial=0)), int(rank.max(initial=0))) + 1)
    if int(shift) * (plan.limit + 1) < 1 << 62:
        at = np.searchsorted(lengths * shift + ranks, length * shift + rank, "right") - 1
    else:
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            one, two = np.searchsorted(lengths, [n, n + 1])
            own = length == n
            at[own] = one + np.searchsorted(ranks[one:two], rank[own], "right") - 1
    within = rank - ranks[at]
    return sequence[at] + within // each[at], offset[at] + within % each[at] * length


PIECES = "doc_tokens bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _shard bigint, _rank bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END, limit: int = TOKENS) -> DataFrame:
    """The pieces of each text's ids and the end id, numbered by length within shards of rows.

    A text of more than `limit` ids is cut from its end into pieces of `limit`, so the first may be
    shorter. Null and empty texts are the end id alone; repeated rows have pieces of their own.
    """
    base, at, key_at = numbered(docs.select(key, text)), place(docs.select(key, text), text), place(docs.select(key, text), key)
    kind = base.schema[key_at].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, met = TaskContext.get().partitionId() << 20, np.zeros(limit + 1, np.int64), 0
        for batch in batches:
            keys = column(batch, key_at)
            for first, ids, bounds in encoded(column(batch, at), tokenizer):
                total = np.diff(bounds) + 1
                parts = -(-total // limit)
                row = np.repeat(np.arange(len(total)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = total - (parts - 1) * limit
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * limit)
                length = np.where(piece == 0, head[row], limit)
                ends_here = piece == parts[row] - 1
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                begin = 4 * (bounds[row] + start)
                stop = begin + 4 * (length - ends_here)
                crc = [zlib.crc32(last, zlib.crc32(raw[a:b])) if e else zlib.crc32(raw[a:b]) for a, b, e in zip(begin.tolist(), stop.tolist(), ends_here.tolist(), strict=True)]
                # a piece's number among those of its length, in the order of rows
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=limit + 1)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
                seen += sizes
                arrays = [keys.take(pa.array(first + row)), pa.array(total[row]), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), shard)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_tokens", "piece", "start", "length", "ids_crc32", "_shard", "_rank"])
                met += len(row)
                if met > SHARD:
                    shard, met = shard + 1, 0
                    seen[:] = 0

    return base.select(key_at, at).mapInArrow(pieces, f"key {kind}, {PIECES}")


def packed(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END, limit: int = TOKENS) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens.

    Sequences are numbered from 0 and hold at most `limit` ids, their pieces without a gap. Which
    of two pieces of the same length takes a slot follows from where the rows are read, so ties
    and repeated rows get slots of their own in that order. Null keys are keys, an empty table
    gives no rows, and other columns are not read. A text is encoded whole by its task, at some
    twenty bytes of memory a byte.
    """
    pieces = cut_lineage(cut_pieces(docs, tokenizer, text, key, end, limit), "histogram-pieces")
    shards = pieces.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    shards = cut_lineage(shards, "histogram-shards")
    # at most `limit` rows, whatever the corpus
    counts = {r.length: r.n for r in shards.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = best_fit(counts, limit)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    ranked = with_rank(pieces, shards.select("length", "_shard", F.coalesce(before, F.lit(0)).alias("_before")))
    kind = pieces.schema["key"].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32", "doc_tokens"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots(plan, column(batch, "length").to_numpy(), column(batch, "rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(take, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("key", key)


def with_rank(pieces: DataFrame, offsets: DataFrame) -> DataFrame:
    """The pieces with their rank among all of their length."""
    rank: Column = F.col("_rank") + F.col("_before")
    return pieces.join(offsets, ["length", "_shard"]).withColumn("rank", rank)


def digest(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    return packed(docs.select("doc_id", "text"), tokenizer, end=end).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")
