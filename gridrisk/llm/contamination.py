"""Benchmark decontamination with an FM-index for each shard of the training texts.

A task cuts its texts into shards of about a megabyte, indexes the words of each and searches the
benchmark's windows backwards through the ranks of a wavelet matrix. Sampled suffix positions turn
the matches into places, and the windows' places merge into spans to remove. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridrisk.llm.text import chunks, column, counts, long_list, named_back, numbered, place, words
from gridrisk.session import cut_lineage

WINDOW = 10  # words of a window
BLOCK_BYTES = 8 << 20  # benchmark text searched in one pass; a larger benchmark takes more passes
SAMPLE = 16  # every so many suffix positions are kept


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order; the last symbol is 0 and the only one."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, 62 // bits)
    padded = np.zeros(n + depth, np.int64)
    padded[:n] = symbols
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    while True:
        # a group's rank is the place of its first member, so places outside a group stay as they are
        heads = np.flatnonzero(fresh)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            return order
        rest = order[tied]
        pair = rank[rest] * (n + 1) + rank[rest + depth]
        by = np.argsort(pair, kind="stable")
        order[tied] = rest[by]
        pair = pair[by]
        fresh[tied] = np.append(True, pair[1:] != pair[:-1])
        depth *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols that ends in its only 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.n, self.sigma = len(symbols), int(symbols.max()) + 1
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.before = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=self.sigma), out=self.before[1:])
        self.ones, self.zeros, rest = [], [], last
        for level in reversed(range(self.levels)):
            bit = ((rest >> level) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            rest = np.concatenate([rest[~bit], rest[bit]])
        alphabet = np.arange(self.sigma)
        self.base = self._down(alphabet, np.zeros(self.sigma, np.int64))
        self.position = np.where(order % sample == 0, order, -1)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            before = ones[at]
            at = np.where((symbol >> level) & 1, zeros + before, at - before)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the rows before `at` that follow `symbol` end among the suffixes it begins."""
        return self.before[symbol] + self._down(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, row after the last) of the patterns, one a row, that occur."""
        known = (patterns < self.sigma).all(axis=1)
        live = np.flatnonzero(known)
        seen = np.diff(self.before) > 0
        live = live[seen[patterns[live]].all(axis=1)]
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[live, k]
            low, high = self.step(symbol, low), self.step(symbol, high)
            left = low < high
            live, low, high = live[left], low[left], high[left]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these rows, by walking back to a sampled one."""
        found = self.position[rows]
        steps = 0
        open_ = np.flatnonzero(found < 0)
        at = rows[open_]
        while len(open_):
            symbol, down = np.zeros(len(at), np.int64), at
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                before = ones[down]
                bit = ones[down + 1] > before
                symbol = symbol * 2 + bit
                down = np.where(bit, zeros + before, down - before)
            at = self.before[symbol] + down - self.base[symbol]
            steps += 1
            here = self.position[at]
            known = here >= 0
            found[open_[known]] = here[known] + steps
            open_, at = open_[~known], at[~known]
        return found


class Phrases:
    """The windows of a block of benchmark items, as symbols of their own vocabulary."""

    def __init__(self, items: pd.DataFrame, window: int):
        texts = pa.array(items["text"].tolist(), pa.large_string())
        found: dict[tuple[int, ...], set[str]] = {}
        sequences: list[tuple[str, np.ndarray]] = []
        for first, last, data, bounds in chunks(texts):
            _, _, row, hashed = words(data, bounds)
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            sequences += [(str(items["item_id"].iloc[first + k]), hashed[cuts[k] : cuts[k + 1]]) for k in range(last - first)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in sequences)]))
        for item, hashed in sequences:
            # 0 ends a shard, 1 stands for words that no item has
            symbols = (np.searchsorted(self.vocabulary, hashed) + 2).tolist()
            size = min(window, len(symbols))
            for k in range(len(symbols) - size + 1 if size else 0):
                found.setdefault(tuple(symbols[k : k + size]), set()).add(item)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for window_ in found:
            by_size.setdefault(len(window_), []).append(window_)
        self.groups = [(np.array(v, np.int64), [sorted(found[w]) for w in v]) for _, v in sorted(by_size.items())]

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 2, 1)


def marked(data: np.ndarray, bounds: np.ndarray, phrases: Phrases):
    """Per row of the chunk: words, which words are hit, and the items found; the words' bytes."""
    rows = len(bounds) - 1
    begin, end, row, hashed = words(data, bounds)
    hit = np.zeros(len(begin) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(rows)]
    symbols = phrases.symbols(hashed)
    if (symbols > 1).any():
        firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        sequence = np.append(np.insert(symbols, firsts, 1), 0)
        word = np.append(np.insert(np.arange(len(begin)), firsts, -1), -1)
        kept = ~((sequence == 1) & np.append(False, sequence[:-1] == 1))
        sequence, word = sequence[kept], word[kept]
        index = FMIndex(sequence)
        for patterns, owners in phrases.groups:
            which, low, high = index.search(patterns)
            if not len(which):
                continue
            sizes = high - low
            owner = np.repeat(which, sizes)
            places = word[index.locate(np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))]
            np.add.at(hit, places, 1)
            np.subtract.at(hit, places + patterns.shape[1], 1)
            for r, w in np.unique(np.stack([row[places], owner], axis=1), axis=0):
                items[r].update(owners[w])
    return begin, end, row, np.cumsum(hit)[:-1] > 0, items


def runs(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each longest run of flags within a row."""
    other = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    before = np.append(False, flags[:-1]) if len(flags) else flags
    first = np.flatnonzero(flags & (other | ~before))
    after = np.append(flags[1:], False) if len(flags) else flags
    last = np.flatnonzero(flags & (np.append(other[1:], True) | ~after)) if len(flags) else first
    return first, last


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False, keep_text: bool = True) -> DataFrame:
    """All rows and columns of `docs` and a struct `_hits` of what the benchmark marks in `text`.

    `_hits`: n_words; n_hit; words, the runs of hit words as [first, after last, ...]; bytes, the
    same runs as UTF-8 byte offsets; items, the ids of items with an occurring window, sorted as
    strings. A word is hit if it lies inside any place where a window of `window` consecutive
    words of an item stands; an item of fewer words is one window, an item of none is none.
    With `cut` the runs are removed from `text`, each leaving a space.

    Null and empty texts have no words, a null item id is the empty string, items that occur twice
    count once, repeated rows are marked alike, an empty benchmark marks nothing and an empty
    `docs` gives no rows. Input columns may have any names but `_hits`.
    """
    spark, at = docs.sparkSession, place(docs, text)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    none, longs = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    current = numbered(docs).select("*", none.alias("n_words"), none.alias("n_hit"), longs.alias("words"), longs.alias("bytes"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        # one block of bounded size comes to the driver at a time and goes out with the tasks
        here = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toPandas()
        phrases, last = spark.sparkContext.broadcast(Phrases(here, window)), block == blocks - 1
        schema = StructType([f for f in current.schema if keep_text or not last or f.name != at])
        current = current.mapInArrow(_marker(phrases, at, cut and last, schema.names), schema)
        if not last:
            current = cut_lineage(current, "contamination")
    return current.select(*named_back(docs, F.struct("n_words", "n_hit", "words", "bytes", "items").alias("_hits"), skip=() if keep_text else (text,)))


def _marker(phrases, at: str, cut: bool, names: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, earlier, known = column(batch, at), column(batch, "words"), column(batch, "items")
            for first, last, data, bounds in chunks(texts):
                begin, end, row, hit, items = marked(data, bounds, phrases.value)
                total = counts(row, last - first)
                starts = np.cumsum(total) - total
                for k, spans in enumerate(earlier.slice(first, last - first).to_pylist()):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        hit[starts[k] + a : starts[k] + b] = True
                    items[k].update(known[first + k].as_py())
                one, two = runs(hit, row)
                of = row[one]
                sizes = 2 * counts(of, last - first)
                in_words = np.stack([one - starts[of], two + 1 - starts[of]], axis=1).ravel()
                in_bytes = np.stack([begin[one] - bounds[of], end[two] - bounds[of]], axis=1).ravel()
                part = batch.slice(first, last - first)
                new = {"n_words": pa.array(total.astype(np.int64)), "n_hit": pa.array(counts(row[hit], last - first).astype(np.int64)), "words": long_list(in_words, sizes), "bytes": long_list(in_bytes, sizes), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                if cut and len(one):
                    new[at] = without_spans(column(part, at), new["bytes"])
                yield pa.RecordBatch.from_pydict({f.name: new.get(f.name, part.column(k)).cast(f.type) for k, f in enumerate(batch.schema) if f.name in names})

    return mark


def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the byte spans [first, after last, ...], each of which leaves a space."""
    out = texts.to_pylist()
    for k, places in enumerate(spans.to_pylist()):
        if places:
            raw, at, left = out[k].encode(), 0, []
            for a, b in zip(places[::2], places[1::2], strict=True):
                left.append(raw[at:a])
                at = b
            out[k] = b" ".join([*left, raw[at:]]).decode()
    return pa.array(out, texts.type)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` with every run of hit words, and what stands between them, cut out of `text`.

    A document that keeps no word, having had some, goes; `n_chars`, if there, follows the text.
    """
    found = contamination(docs, benchmark, cut=True, **options)
    left = found.where((F.col("_hits.n_words") == 0) | (F.col("_hits.n_hit") < F.col("_hits.n_words")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("_hits.n_hit") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.drop("_hits")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: counts of words, hit words and items, and the items' hash."""
    found = contamination(docs.select("doc_id", "text"), benchmark, keep_text=False)
    return found.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        F.col("_hits.n_hit").alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )
