"""Examples packed into training sequences: vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens. The open sequence takes
the example whose demands have the largest weighted dot product with what is left of its limits;
when none fits whole, the best is cut to fill it. Each task packs what it reads, pool by pool, and
hands on only its last open sequence; those of all tasks are packed together in the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.text import column, numbered, place
from gridrisk.llm.tokens import encoded
from gridrisk.session import cut_lineage

TOKENS = 2048
SEGMENTS = 128
END = 1  # the id after each document
POOL = 512  # examples packed at once
TOGETHER = 2000  # open sequences packed by one task in the end


class Piece:
    """Ids [start, start + length) of a document, and how many of them bear loss."""

    __slots__ = ("doc", "start", "ids", "loss")

    def __init__(self, doc: tuple, start: int, ids: np.ndarray, loss: np.ndarray | None):
        self.doc, self.start, self.ids, self.loss = doc, start, ids, loss

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, at: int) -> tuple[Piece, Piece]:
        one = None if self.loss is None else self.loss[:at]
        two = None if self.loss is None else self.loss[at:]
        return Piece(self.doc, self.start, self.ids[:at], one), Piece(self.doc, self.start + at, self.ids[at:], two)


def head(piece: Piece, tokens: int, loss: int) -> int:
    """The longest beginning of the piece within both limits."""
    most = min(tokens, len(piece.ids))
    if piece.loss is not None:
        most = int(np.searchsorted(np.cumsum(piece.loss[:most]), loss, "right"))
    else:
        most = min(most, loss)
    return most


def pack_pool(pieces: list[Piece], limits: tuple[int, int, int], final: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """(full sequences, pieces of the sequence left open); with `final` the last one is closed too.

    Ties go to the example that came first. Each piece costs one scan over the pool.
    """
    pieces = list(pieces)
    demands = np.array([p.demand() for p in pieces], float).reshape(-1, 3)
    tokens, loss = demands[:, 0].copy(), demands[:, 2].copy()
    # every example is one segment, so that limit decides what fits but not which is best
    weight = demands.mean(axis=0) / np.array(limits, float) ** 3 if len(pieces) else np.zeros(3)
    done: list[list[Piece]] = []
    sequence: list[Piece] = []
    left = list(limits)
    remaining = len(pieces)
    while remaining:
        fits = np.flatnonzero((tokens <= left[0]) & (loss <= left[2])) if left[1] > 0 else ()
        whole = len(fits) > 0
        some = fits if whole else np.flatnonzero(tokens < np.inf)
        best = int(some[(tokens[some] * (weight[0] * left[0]) + loss[some] * (weight[2] * left[2])).argmax()])
        if whole:
            taken = pieces[best]
            tokens[best] = np.inf
            remaining -= 1
        else:
            size = head(pieces[best], left[0], left[2]) if left[1] > 0 else 0
            if size == 0:
                done.append(sequence)
                sequence, left = [], list(limits)
                continue
            taken, pieces[best] = pieces[best].cut(size)
            tokens[best], _, loss[best] = pieces[best].demand()
        sequence.append(taken)
        left = [x - y for x, y in zip(left, taken.demand(), strict=True)]
        if left[0] == 0 or left[1] == 0:
            done.append(sequence)
            sequence, left = [], list(limits)
    if final and sequence:
        done.append(sequence)
        sequence = []
    return done, sequence


def whole_sequences(doc: tuple, ids: np.ndarray, loss: np.ndarray | None, limits: tuple[int, int, int]) -> tuple[list[Piece], Piece | None]:
    """(pieces that fill a sequence each, the rest) of a document."""
    rest, out = Piece(doc, 0, ids, loss), []
    while len(rest.ids) >= limits[0] or rest.demand()[2] > limits[2]:
        size = head(rest, limits[0], limits[2])
        if size < limits[0] and size < len(rest.ids) or size == 0:
            break
        one, rest = rest.cut(size)
        out.append(one)
    return out, rest if len(rest.ids) else None


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, loss binary"


def packed(docs: DataFrame, examples: Callable[[pa.RecordBatch], Iterator[tuple[int, bytes, bytes | None]]], key: str = "doc_id", limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), keep_ids: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `examples` gives (row, ids as little-endian 32-bit string, loss mask as bytes or None) for the
    rows of a batch whose columns are numbered c0, c1, ... `limits` hold tokens, segments and
    loss-bearing tokens of a sequence. With `keep_ids` the pieces carry their ids and loss masks.
    Documents without ids have no piece; repeated rows are packed each; an empty table gives none.
    """
    base, key_at = numbered(docs), place(docs, key)
    kind = base.schema[key_at].dataType.simpleString()
    schema = f"key {kind}, {SCHEMA}"

    def table(keys: pa.Array, done: list[tuple[int, list[Piece]]], open_: list[Piece], keep: bool) -> pa.RecordBatch:
        rows = [(p, number, offset, keep) for number, sequence in done for p, offset in zip(sequence, np.cumsum([0, *[len(p.ids) for p in sequence]]), strict=False)]
        rows += [(p, None, None, True) for p in open_]
        strings = [p.ids.astype("<u4").tobytes() for p, *_ in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p.doc[0] for p, *_ in rows], keys),
                pa.array([p.start for p, *_ in rows], pa.int64()),
                pa.array([len(p.ids) for p, *_ in rows], pa.int64()),
                pa.array([zlib.crc32(s) for s in strings], pa.int64()),
                pa.array([p.doc[1] for p, *_ in rows], pa.int64()),
                pa.array([n for _, n, *_ in rows], pa.int64()),
                pa.array([None if o is None else int(o) for _, _, o, _ in rows], pa.int64()),
                pa.array([s if kept else None for s, (*_, kept) in zip(strings, rows, strict=True)], pa.binary()),
                pa.array([p.loss.astype(np.uint8).tobytes() if kept and p.loss is not None else None for p, _, _, kept in rows], pa.binary()),
            ],
            names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "loss"],
        )

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pool: list[Piece] = []
        keys = None
        for batch in batches:
            names = column(batch, key_at)
            keys = names.type
            done: list[list[Piece]] = []
            for k, raw, mask in examples(batch):
                ids = np.frombuffer(raw, "<u4")
                if len(ids):
                    loss = None if mask is None else np.frombuffer(mask, np.uint8) != 0
                    full, rest = whole_sequences((names[k].as_py(), len(ids)), ids, loss, limits)
                    done += [[p] for p in full]
                    if rest is not None:
                        pool.append(rest)
                if len(pool) >= POOL:
                    more, pool = pack_pool(pool, limits, final=False)
                    done += more
                if len(done) >= 4 * POOL:
                    yield table(keys, list(enumerate(done, number)), [], keep_ids)
                    number += len(done)
                    done = []
            if done:
                yield table(keys, list(enumerate(done, number)), [], keep_ids)
                number += len(done)
        if pool:
            done, open_ = pack_pool(pool, limits, final=False)
            yield table(keys, list(enumerate(done, number)), open_, keep_ids)

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (1 << 62) + (TaskContext.get().partitionId() << 32)
        pool: list[Piece] = []
        keys = None
        for batch in batches:
            keys = column(batch, "key").type
            for k in range(len(batch)):
                mask = column(batch, "loss")[k].as_py()
                pool.append(Piece((column(batch, "key")[k].as_py(), column(batch, "doc_tokens")[k].as_py()), column(batch, "start")[k].as_py(), np.frombuffer(column(batch, "ids")[k].as_py(), "<u4"), None if mask is None else np.frombuffer(mask, np.uint8) != 0))
            if len(pool) >= POOL:
                done, pool = pack_pool(pool, limits, final=False)
                yield table(keys, list(enumerate(done, number)), [], keep_ids)
                number += len(done)
        if pool:
            done, _ = pack_pool(pool, limits, final=True)
            yield table(keys, list(enumerate(done, number)), [], keep_ids)

    pieces = cut_lineage(base.mapInArrow(first_pass, schema), "packed-pieces")
    closed, open_ = pieces.where("sequence_id is not null"), pieces.where("sequence_id is null")
    tokens = open_.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (limits[0] * TOGETHER)))
    ended = open_.coalesce(tasks).mapInArrow(last_pass, schema)
    both = closed.unionByName(ended)
    return both.withColumnRenamed("key", key) if keep_ids else both.drop("ids", "loss").withColumnRenamed("key", key)


def packed_texts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END, **options) -> DataFrame:
    """Whole texts, each followed by `end`, packed; every token of plain text bears loss.

    Null and empty texts are the end id alone.
    """
    rows = docs.select(key, text)
    at, last = place(rows, text), np.array([end], "<u4").tobytes()

    def examples(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, None]]:
        for k, ids in encoded(column(batch, at), tokenizer):
            yield k, ids + last, None

    return packed(rows, examples, key, **options)
