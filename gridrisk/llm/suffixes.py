"""Exact repeated substrings: bytes of every string of 200 that also starts anywhere else are removed.

Texts are parsed by content: each window of 200 bytes belongs to the least 32-byte gram in it, and
consecutive windows of one gram make a fragment, so equal windows, wherever they stand, lie in
fragments of the same gram. Fragments that occur whole elsewhere are settled by counting. The
others of a gram go, as shards, into a merge of their Burrows-Wheeler transforms: starting with the
shards one after the other, the interleaving of all suffixes is refined by the symbol before each,
four symbols of 50 bytes to a window, and intervals that stay together have a common prefix of 200
bytes. No suffixes are compared or sorted by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.text import Hasher, chunks, column, numbered, place
from gridrisk.session import cut_lineage

LENGTH = 200  # bytes of a string that must not occur twice
GRAM = 32
SYMBOLS = 4  # of a window
PLACE_BITS = 27  # texts of up to 128 MB
MERGED_BYTES = 2 << 20  # fragments merged at once
CROWDED = 2000  # different fragments of a gram, beyond which they are dealt out by more than the gram
SPLIT = 4  # parts of the windows of such a fragment, and of each part again


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(rows, width)
    after = np.minimum.accumulate(table, axis=1).ravel()
    before = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def fragments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, gram, hash of the bytes) of all fragments of a chunk."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = Hasher(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hasher.ranges(at, at + GRAM)
    high = np.uint64(PLACE_BITS)
    least = sliding_least((grams >> high << high) | at.astype(np.uint64), LENGTH - GRAM + 1)
    anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(bounds, start, "right") - 1
    inside = start + LENGTH <= bounds[row + 1]
    start, row, anchor = start[inside], row[inside], anchor[inside]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    size = np.diff(np.append(head, len(start)))
    first = start[head]
    return row[head], first - bounds[row[head]], size, grams[anchor[head]], hasher.ranges(first, first + size + LENGTH - 1)


def interleaved(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in merged order, interval of each): intervals agree in all symbols.

    `symbols[t]` holds symbol t of every suffix, shard after shard. Each pass takes the suffixes
    in the interleaving so far and deals them, in that order, to the buckets of the symbol before;
    a suffix opens an interval if its symbol is new in the bucket or the suffix before it in the
    last interleaving belonged to another interval.
    """
    order = np.arange(len(symbols[0]))
    interval = np.zeros(len(order), np.int64)
    for symbol in reversed(symbols):
        before = symbol[order]
        dealt = np.argsort(before, kind="stable")
        order, interval, before = order[dealt], interval[dealt], before[dealt]
        opens = np.ones(len(order), bool)
        opens[1:] = (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(opens) - 1
    return order, interval


def repeated_windows(texts: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each fragment, which of its windows occur twice or more, fragments counting by weight."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    fragment = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(fragment)) - np.repeat(np.cumsum(windows) - windows, windows) + first[fragment]
    hasher, step = Hasher(data), LENGTH // SYMBOLS
    order, interval = interleaved([hasher.ranges(at + t * step, at + (t + 1) * step) for t in range(SYMBOLS)])
    total = np.bincount(interval, weights=weights[fragment[order]])
    twice = np.zeros(len(order), bool)
    twice[order] = total[interval] > 1.5
    return np.split(twice, np.cumsum(windows)[:-1])


def _fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, last, data, bounds in chunks(column(batch, "text")):
            row, first, size, gram, whole = fragments(data, bounds)
            of = pa.array(row)
            own = [column(batch, n).slice(at, last - at).take(of) for n in ("key", "tkey")]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), *own, pa.array(first), pa.array(size)], names=["gram", "whole", "key", "tkey", "first", "size"])


def _fragment_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            raw = column(batch, "text")[k].as_py().encode()
            wanted = column(batch, "wanted")[k].as_py()
            one = pa.array(np.full(len(wanted), k))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([w[n] for w in wanted], pa.int64()) for n in ("gram", "n", "crowd", "first", "size")], column(batch, "key").take(one), column(batch, "tkey").take(one), pa.array([raw[w["first"] : w["first"] + w["size"] + LENGTH - 1] for w in wanted], pa.binary())],
                names=["gram", "n", "crowd", "first", "size", "key", "tkey", "bytes"],
            )


def _spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Spans of the repeated windows of the fragments that occur once."""
    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    n = np.array(column(table, "n"))
    twice = repeated_windows(column(table, "bytes").to_pylist(), n.astype(float))
    first = np.array(column(table, "first"))
    of, start, end = [], [], []
    for k, flags in enumerate(twice):
        if n[k] == 1 and flags.any():
            edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of += [k] * len(a)
            start += (first[k] + a).tolist()
            end += (first[k] + b - 1 + LENGTH).tolist()
    one = pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays([column(table, "key").take(one), column(table, "tkey").take(one), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["key", "tkey", "start", "end"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the fragments of whole grams, some megabytes at a time; rows come ordered by gram."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        gram = np.array(column(batch, "gram"))
        cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
        lengths = np.array(column(batch, "size")) + LENGTH
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and size > MERGED_BYTES and column(held[-1], "gram")[-1].as_py() != gram[a]:
                yield _spans(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(lengths[a:b].sum())
    if held:
        yield _spans(held)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment's windows in up to `SPLIT` parts, by the places of the gram in them.

    `lo` to `hi` are the places, `at` is that of the gram in the fragment, -1 before the first
    split. `core` is the hash of the bytes that all windows of a part have in common, which equal
    windows of other fragments have too, and `whole` that of all bytes of the part.
    """
    for batch in batches:
        of, held, raws = [], [[], [], [], [], [], [], []], []
        for k, row in enumerate(batch.select(["gram", "first", "size", "at", "lo", "hi", "bytes"]).to_pylist()):
            data, at, lo, hi = np.frombuffer(row["bytes"], np.uint8), row["at"], row["lo"], row["hi"]
            hasher = Hasher(data)
            if at < 0:
                begin = np.arange(len(data) - GRAM + 1)
                at = int(np.argmax(hasher.ranges(begin, begin + GRAM).view(np.int64) == row["gram"]))
            step = -(-(hi - lo + 1) // SPLIT)
            low = np.arange(lo, hi + 1, step)
            high = np.minimum(low + step - 1, hi)
            first, last = np.maximum(0, at - high), np.minimum(row["size"] - 1, at - low)
            some = first <= last
            low, high, first, last = low[some], high[some], first[some], last[some]
            core, whole = hasher.ranges(at - low, at - high + LENGTH).view(np.int64), hasher.ranges(first, last + LENGTH).view(np.int64)
            of += [k] * len(low)
            for values, x in zip(held, (core, whole, row["first"] + first, last - first + 1, at - first, low, high), strict=True):
                values += x.tolist()
            raws += [row["bytes"][a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        one = pa.array(of, pa.int64())
        own = [column(batch, n).take(one) for n in ("n", "key", "tkey")]
        yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.int64()) for x in held], pa.array(raws, pa.binary())], names=["n", "key", "tkey", "core", "whole", "first", "size", "at", "lo", "hi", "bytes"])


def dealt_out(crowd: DataFrame, crowded: int, kind: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(spans, fragments to merge) of the fragments of grams in very many different surroundings.

    The windows of a fragment are split by the place of the gram in them, and parts are brought
    together by the bytes that all their windows have in common. A part that no other has the core
    of is done, equal parts are settled by counting, those of a core with no more than `crowded`
    different parts go to the merge, with the core for their gram, and the others are split again.
    A window alone is its own core, so rounds end after the fourth.
    """
    spans = merges = None
    live = crowd.select("gram", "n", "key", "tkey", "first", "size", "bytes", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("lo"), F.lit(LENGTH - GRAM).cast("long").alias("hi"))
    while live.limit(1).count():
        parts = cut_lineage(live.mapInArrow(_parts, f"n bigint, key {kind}, tkey bigint, core bigint, whole bigint, first bigint, size bigint, at bigint, lo bigint, hi bigint, bytes binary"), "suffix-parts")
        kinds = parts.groupBy("core", "lo", "hi", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("key", "tkey", "first", "size", "at", "bytes")).alias("one"))
        kinds = cut_lineage(kinds, "suffix-part-kinds")
        equal = parts.where("n = 1").join(kinds.where("n > 1").select("core", "lo", "hi", "whole"), ["core", "lo", "hi", "whole"], "left_semi").select("key", "tkey", "first", "size")
        spans = equal if spans is None else spans.unionByName(equal)
        crowds = kinds.groupBy("core", "lo", "hi").agg(F.count("*").alias("crowd")).where("crowd > 1")
        left = kinds.join(crowds, ["core", "lo", "hi"]).select(F.xxhash64("core", "lo", "hi").alias("gram"), "n", "crowd", "one.*", "lo", "hi")
        left = cut_lineage(left, "suffix-parts-left")
        few = left.where(F.col("crowd") <= crowded).select("gram", "n", "first", "size", "key", "tkey", "bytes")
        merges = few if merges is None else merges.unionByName(few)
        live = left.where(F.col("crowd") > crowded)
    return spans, merges


def repeated_spans(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(key, tkey, start, end): byte spans covered by strings that start elsewhere too, overlapping.

    `rows` has key, tkey and text; rows equal in key and tkey are copies with the same spans.
    """
    kind = rows.schema["key"].dataType.simpleString()
    # made twice rather than kept, and counted map-side the first time
    found = rows.mapInArrow(_fragment_rows, f"gram bigint, whole bigint, key {kind}, tkey bigint, first bigint, size bigint")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("whole") == F.max("whole")).alias("uniform")).where("n > 1")
    grams = cut_lineage(grams.select("gram", "uniform"), "suffix-grams")
    shared = cut_lineage(found.join(grams, "gram"), "suffix-fragments")
    whole = shared.where("uniform")
    mixed = shared.where("not uniform")
    kinds = mixed.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "tkey", "first", "size")).alias("one"))
    kinds = cut_lineage(kinds, "suffix-kinds")
    twice = mixed.join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")
    crowds = kinds.groupBy("gram").agg(F.count("*").alias("crowd"))
    wanted = kinds.join(crowds, "gram").select("gram", "n", "crowd", "one.*")
    wanted = wanted.groupBy("key", "tkey").agg(F.collect_list(F.struct("gram", "n", "crowd", "first", "size")).alias("wanted"))
    texts = rows.withColumnsRenamed({"key": "key2", "tkey": "tkey2"})
    own = wanted.join(texts, F.col("key").eqNullSafe(F.col("key2")) & (F.col("tkey") == F.col("tkey2"))).select("key", "tkey", "text", "wanted")
    pieces = cut_lineage(own.mapInArrow(_fragment_bytes, f"gram bigint, n bigint, crowd bigint, first bigint, size bigint, key {kind}, tkey bigint, bytes binary"), "suffix-pieces")
    spans = f"key {kind}, tkey bigint, start bigint, end bigint"
    alone = pieces.where(F.col("crowd") <= crowded).select("gram", "n", "first", "size", "key", "tkey", "bytes")
    # a gram in very many different surroundings is not brought together
    equal, few = dealt_out(pieces.where(F.col("crowd") > crowded), crowded, kind)
    merged = (alone if few is None else alone.unionByName(few)).repartition("gram").sortWithinPartitions("gram").mapInArrow(_merge, spans)
    settled = whole.select("key", "tkey", "first", "size").unionByName(twice.select("key", "tkey", "first", "size"))
    full = (settled if equal is None else settled.unionByName(equal)).select("key", "tkey", F.col("first").alias("start"), (F.col("first") + F.col("size") + LENGTH - 1).alias("end"))
    return full.unionByName(merged)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_bytes: bool = True) -> DataFrame:
    """The key of every row with n_bytes, n_removed, n_spans, spans, kept_sha256 and the kept bytes.

    Every byte inside a string of 200 bytes that also starts anywhere else goes, in all its places.
    Spans are the longest removed runs as [first, after last, ...]. Null texts are empty; texts
    under 200 bytes stay whole; rows that repeat whole remove each other; null keys are a value
    like others; an empty table gives an empty one. Texts may have up to 128 MB.
    """
    base, at, key_at = numbered(docs), place(docs, text), place(docs, key)
    rows = base.select(F.col(key_at).alias("key"), F.coalesce(F.col(at), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    spans = repeated_spans(rows.where(F.octet_length("text") >= LENGTH))
    by_row = spans.groupBy("key", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"key": "key2", "tkey": "tkey2"})
    joined = rows.join(by_row, F.col("key").eqNullSafe(F.col("key2")) & (F.col("tkey") == F.col("tkey2")), "left").select("key", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for value, found in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                raw, runs = value.encode(), []
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                here, left = 0, []
                for a, b in runs:
                    left.append(raw[here:a])
                    here = b
                kept = b"".join([*left, raw[here:]])
                for values, x in zip(out, (len(raw), len(raw) - len(kept), len(runs), [x for r in runs for x in r], hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None), strict=True):
                    values.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], names=["key", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    done = joined.mapInArrow(cut, f"key {base.schema[key_at].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept_sha256 string, kept binary")
    return done.withColumnRenamed("key", key)


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text"), keep_bytes=False).drop("kept", "spans")
