"""Words of whole texts as numpy arrays: spans and 64-bit hashes of every word of an Arrow batch.

A text is held whole by the task that reads it; the arrays take about 40 bytes for each byte of
the texts at hand, which `chunks` bounds for all texts but those longer than a chunk themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes of text worked on at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters after lower-casing, and every byte of a character outside ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WEIGHT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, factor in (("up", BASE), ("down", INVERSE)):
            row = np.full(n, factor, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds of the rows in them), a null text being empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


class Hasher:
    """Hashes of any byte ranges of one chunk."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(WEIGHT[data] * up[:-1], out=self.sums[1:])

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row, hash) of each word of the chunk, lower-cased.

    A word is a longest run of digits, Latin letters and characters outside ASCII in one text.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    follows = np.zeros(len(data) + 1, bool)
    follows[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (cut | ~follows))
    end = np.flatnonzero(follows & (cut | ~inside))
    row = np.searchsorted(bounds, begin, "right") - 1
    return begin, end, row, Hasher(LOWER[data]).ranges(begin, end)


def counts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, minlength=rows)


def long_list(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list of longs for each row, from all values in order and the lists' sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbered(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name of the caller's meets one of an operator's."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """What `numbered` calls the column."""
    return f"c{docs.columns.index(name)}"


def named_back(docs: DataFrame, *more: Column, skip: tuple[str, ...] = ()) -> list[Column]:
    """What to select from the numbered table for the columns of `docs`, and more."""
    return [F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns) if name not in skip] + list(more)
