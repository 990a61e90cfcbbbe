"""Repeated passages: runs of consecutive sentences, hashed, joined over the corpus and removed.

Every run of one to three sentences that holds enough words is hashed by its lower-cased words. A
run's first place in the corpus stays; the sentences of its other places go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.text import chunks, column, mix, numbered, place, powers, words
from gridrisk.session import cut_lineage

#: Sentences of a run and the words it must hold, so that common short sentences are left alone.
RUNS = ((1, 50), (2, 20), (3, 12))

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def sentences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after, row, first word, word after, word hashes) of sentences with a word.

    A sentence ends after a line feed, and after a blank that follows a full stop, an exclamation
    or a question mark; together with what has no word the sentences of a text make up all of it.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[2:] |= (data[1:] == 32) & _ENDS[data[:-1]]
    cut[bounds] = True
    first = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    after = np.append(first[1:], len(data))
    begin, _, _, hashed = words(data, bounds)
    low, high = np.searchsorted(begin, first), np.searchsorted(begin, after)
    some = high > low
    first, after, low, high = first[some], after[some], low[some], high[some]
    return first, after, np.searchsorted(bounds, first, "right") - 1, low, high, hashed


def run_hashes(row: np.ndarray, low: np.ndarray, high: np.ndarray, hashed: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(sentences, first sentences, hashes) of the runs that hold enough words."""
    up, down = powers(len(hashed) + 1)
    sums = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum((hashed | np.uint64(1)) * up[:-1], out=sums[1:])
    out = []
    for size, least in RUNS:
        one = np.arange(max(0, len(row) - size + 1))
        last = one + size - 1
        one = one[(row[one] == row[last]) & (high[last] - low[one] >= least)]
        a, b = low[one], high[one + size - 1]
        out.append((size, one, mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))))
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, last, data, bounds in chunks(column(batch, "text")):
            _, _, row, low, high, hashed = sentences(data, bounds)
            number = np.arange(len(row)) - np.searchsorted(row, np.arange(last - at))[row] if len(row) else row
            found = run_hashes(row, low, high, hashed)
            one = np.concatenate([x for _, x, _ in found])
            size = np.concatenate([np.full(len(x), s) for s, x, _ in found])
            of = pa.array(row[one])
            own = [column(batch, n).slice(at, last - at).take(of) for n in ("key", "_rid")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for *_, h in found]).view(np.int64)), *own, pa.array(number[one]), pa.array(size)], names=["hash", "key", "_rid", "sentence", "size"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        for at, last, data, bounds in chunks(texts):
            first, after, row, *_ = sentences(data, bounds)
            cuts = np.searchsorted(row, np.arange(last - at + 1))
            total, removed, spans, kept = [], [], [], []
            for k, gone in enumerate(column(batch, "gone").slice(at, last - at).to_pylist()):
                total.append(int(cuts[k + 1] - cuts[k]))
                removed.append(len(gone or ()))
                base = bounds[k]
                pieces, here, own = [], base, []
                for s in sorted(gone or ()):
                    a, b = first[cuts[k] + s], after[cuts[k] + s]
                    pieces.append(data[here:a].tobytes())
                    if own and own[-1] == a - base:
                        own[-1] = int(b - base)
                    else:
                        own += [int(a - base), int(b - base)]
                    here = b
                pieces.append(data[here : bounds[k + 1]].tobytes())
                spans.append(own)
                kept.append(b"".join(pieces).decode() if texts[at + k].is_valid else None)
            part = batch.slice(at, last - at)
            new = {"text": pa.array(kept, pa.string()), "n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))}
            names = [n for n in batch.schema.names if n not in ("gone", "text")]
            yield pa.RecordBatch.from_arrays([column(part, n) for n in names] + list(new.values()), names=names + list(new))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of `docs`, `text` without repeated sentences, and a struct `_sentences`.

    `_sentences`: n_sentences, those with a word; n_removed; spans, the UTF-8 byte offsets
    [first, after last, ...] of what was removed. The first place of a run is that of the least
    (key, row, sentence), null keys first; all others lose the run's sentences, in the same text
    too. Null and empty texts have no sentences; of rows that repeat whole, the first in the
    input stays whole; an empty table gives an empty one.
    """
    base, at, key_at = numbered(docs), place(docs, text), place(docs, key)
    staged = cut_lineage(base.withColumn("_rid", F.monotonically_increasing_id()), "sentence-rows")
    # runs are made twice rather than kept: they would take as much disk as the texts
    rows = staged.select("_rid", F.col(key_at).alias("key"), F.col(at).alias("text"))
    runs = rows.mapInArrow(_places, f"hash bigint, key {base.schema[key_at].dataType.simpleString()}, _rid bigint, sentence bigint, size bigint")
    first = F.min(F.struct(F.col("key").isNotNull().alias("some"), "key", "_rid", "sentence")).alias("first")
    repeated = cut_lineage(runs.groupBy("hash").agg(F.count("*").alias("n"), first).where("n > 1").select("hash", F.col("first._rid").alias("first_row"), F.col("first.sentence").alias("first_sentence")), "sentence-runs")
    gone = runs.join(repeated, "hash").where((F.col("_rid") != F.col("first_row")) | (F.col("sentence") != F.col("first_sentence")))
    lost = gone.select("_rid", F.explode(F.sequence("sentence", F.col("sentence") + F.col("size") - 1)).alias("s")).groupBy("_rid").agg(F.collect_set("s").alias("gone"))
    names = [n for n in base.columns if n != at]
    joined = staged.join(lost, "_rid", "left").select(*names, F.col(at).alias("text"), "gone")
    kinds = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names)
    done = joined.mapInArrow(_cut, f"{kinds}{', ' * bool(names)}text string, n_sentences bigint, n_removed bigint, spans array<bigint>")
    back = [F.col("text").alias(n) if f"c{k}" == at else F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)]
    return done.select(*back, F.struct("n_sentences", "n_removed", "spans").alias("_sentences"))


def digest(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"))
    spans = F.transform("_sentences.spans", lambda x: x.cast("string"))
    return found.select("doc_id", F.col("_sentences.n_sentences").alias("n_sentences"), F.col("_sentences.n_removed").alias("n_removed"), F.array_join(spans, ",").alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
