"""Token ids of whole texts, and files of them in patched frame-of-reference blocks.

A file row holds a run of whole documents: their keys, their numbers of ids and one byte string of
blocks. Each block keeps its least id, the other ids less that at a bit width that a stated share
of them fits, and a list of the exceptions; an index of block starts stands before the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrisk.llm import encoding
from gridrisk.llm.text import column, numbered, place
from gridrisk.session import cut_lineage, fresh_path

END = 0  # the id after each document
BLOCK = 1024  # ids of a block
SHARE = 95  # percent of a block's ids that its bit width must hold
SEGMENT = 1 << 17  # ids after which a file row is full

MAGIC = b"PFOR"


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, bytes]]:
    """(place, ids as a little-endian 32-bit string) of each text, null being empty."""
    for first, ids, bounds in encoding.encoded(texts, path):
        raw, ends = ids.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
        for k, (begin, end) in enumerate(zip(ends, ends[1:], strict=False), first):
            yield k, raw[begin:end]


def pack(ids: np.ndarray, block: int = BLOCK, share: int = SHARE) -> bytes:
    """The ids in patched frame-of-reference blocks behind an index of block starts."""
    n = len(ids)
    blocks = -(-n // block)
    rows = np.zeros((blocks, block), np.uint32)
    rows.ravel()[:n] = ids
    if n % block:
        rows[-1, n % block :] = rows[-1, : n % block].min()
    least = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    fitting = np.partition(rest, min(block - 1, block * share // 100), axis=1)[:, min(block - 1, block * share // 100)] if blocks else least
    widths = np.array([int(x).bit_length() for x in fitting], np.int64)
    over = rest >> np.minimum(widths, 31).astype(np.uint32)[:, None] != 0
    over[widths == 32] = False
    packed: dict[int, bytes] = {}
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        low = np.where(over[at], 0, rest[at])
        bits = (low[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1
        for k, row in zip(at, np.packbits(bits.astype(np.uint8).reshape(len(at), -1), axis=1, bitorder="little"), strict=True):
            packed[k] = row.tobytes()
    out, starts, size = [], np.zeros(blocks + 1, "<u4"), 0
    for k in range(blocks):
        places = np.flatnonzero(over[k])
        body = b"".join([int(least[k]).to_bytes(4, "little"), bytes([widths[k]]), len(places).to_bytes(2, "little"), packed[k], places.astype("<u2").tobytes(), rest[k][places].astype("<u4").tobytes()])
        out.append(body)
        size += len(body)
        starts[k + 1] = size
    return b"".join([MAGIC, np.array([n, block], "<u4").tobytes(), starts.tobytes(), *out])


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from `first` up to `last` of a packed string; only their blocks are read."""
    if data[:4] != MAGIC:
        raise ValueError("not a block file")
    n, block = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    last = n if last is None else min(last, n)
    blocks = -(-n // block)
    starts = np.frombuffer(data, "<u4", blocks + 1, 12).astype(np.int64) + 12 + 4 * (blocks + 1)
    one, two = first // block, -(-last // block)
    out = np.zeros((max(two - one, 0), block), np.uint32)
    groups: dict[int, list[int]] = {}
    for k in range(one, two):
        groups.setdefault(data[starts[k] + 4], []).append(k)
    for width, members in groups.items():
        size = -(-block * width // 8)
        raw = np.frombuffer(b"".join([data[starts[k] + 7 : starts[k] + 7 + size] for k in members]), np.uint8).reshape(len(members), size)
        bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : block * width].reshape(len(members), block, width)
        rest = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
        for k, row in zip(members, rest, strict=True):
            at = starts[k] + 7 + size
            count = int.from_bytes(data[starts[k] + 5 : starts[k] + 7], "little")
            row[np.frombuffer(data, "<u2", count, at)] = np.frombuffer(data, "<u4", count, at + 2 * count)
            out[k - one] = row + np.uint32(int.from_bytes(data[starts[k] : starts[k] + 4], "little"))
    return out.ravel()[first - one * block : last - one * block]


def write_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END) -> None:
    """Files of the ids of all texts, each followed by `end`, in ascending order of the key.

    Each part of the key's range is a shard of its own; its rows say which of it they are. Null
    texts are empty, null keys come first, equal keys are ordered by their texts' hash, repeated
    rows each have their ids; an empty table makes files without rows.
    """
    base = numbered(docs)
    at, key_at = place(docs, text), place(docs, key)
    rows = base.select(F.col(key_at).alias("key"), F.col(at).alias("text"), F.xxhash64(at).alias("tie"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    kind = base.schema[key_at].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0

        def row() -> pa.RecordBatch:
            joined = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined)
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([total], pa.int64()), lists, pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())], names=["shard", "segment", "start", "n_ids", "keys", "sizes", "data"])

        for batch in batches:
            for k, ids in encoded(column(batch, "text"), tokenizer):
                keys.append(column(batch, "key").slice(k, 1))
                held.append(ids + last)
                sizes.append(len(held[-1]) // 4)
                total += sizes[-1]
                if total >= SEGMENT:
                    yield row()
                    number, start = number + 1, start + total
                    keys, sizes, held, total = [], [], [], 0
        if keys:
            yield row()

    ordered.mapInArrow(write, f"shard int, segment bigint, start bigint, n_ids bigint, keys array<{kind}>, sizes array<bigint>, data binary").write.parquet(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document from the files: key, start among all ids, n_tokens, ids_crc32, and the ids if asked."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    # a row a shard; written, so that the join below knows how small it is
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut_lineage(totals.select("shard", F.coalesce(before, F.lit(0)).alias("before")), "token-shards")
    placed = files.join(offsets, "shard").select((F.col("before") + F.col("start")).alias("start"), "keys", "sizes", "data")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sizes = np.array(column(batch, "sizes")[k].as_py(), np.int64)
                ids = unpack(column(batch, "data")[k].as_py()).astype("<u4")
                ends = np.cumsum(sizes)
                strings = [ids[b - n : b].tobytes() for b, n in zip(ends, sizes, strict=True)]
                arrays = [column(batch, "keys")[k].values, pa.array(column(batch, "start")[k].as_py() + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(s) for s in strings], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(strings, pa.binary())] * with_ids, names=["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return placed.mapInArrow(read, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = fresh_path(docs.sparkSession, "token-files")
    write_files(docs.select("doc_id", "text"), path, tokenizer)
    return read_files(docs.sparkSession, path).withColumnRenamed("key", "doc_id")
