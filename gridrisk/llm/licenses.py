"""License notices: an exact set-similarity join of text blocks with notice templates.

A block is a line of a text, or a window of a long line or of the whole text, so that a notice
wrapped over lines lies in one. It meets a template if it holds a stated
share of the template's different words. Words are ordered by their frequency over all blocks of
the corpus, the rarest first; a template's prefix in that order must meet the block, and the sizes
and the places of the first common word bound what both can share. What is left is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.text import chunks, column, counts, named_back, numbered, place, words

SHARE = 0.9
BLOCK = 64  # words of a window of a long line or a text; windows begin every BLOCK / 2 words

#: Phrases that name a license wherever their words stand together.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices in the words in which they are usually given.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("proprietary", "all rights reserved"),
)

FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
KINDS = ["bigint", "bigint", "bigint", "bigint", "string", "string", "double"]


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[3]


class Templates:
    """Templates as sets of numbers of their own vocabulary."""

    def __init__(self, templates: tuple[tuple[str, str], ...], share: float):
        hashed = [np.unique(word_hashes(text)) for _, text in templates]
        self.labels = [label for label, _ in templates]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.sets = [np.searchsorted(self.vocabulary, h) for h in hashed]
        self.needed = [max(1, ceil(share * len(s) - 1e-9)) for s in self.sets]

    def numbers(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the words that a template has."""
        if not len(self.vocabulary) or not len(hashed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        places = np.flatnonzero(self.vocabulary[at] == hashed)
        return places, at[places]


def blocks_of(data: np.ndarray, begin: np.ndarray, row: np.ndarray, places: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into places, block, row of the block) for every block that a place lies in."""
    if not len(places):
        return places, places, places
    line = np.searchsorted(np.flatnonzero(data == 10), begin) + row  # a new text is a new line
    index, block = windows_of(line, places, size)
    whole, more = windows_of(row, places, size)
    index, block = np.concatenate([index, whole]), np.concatenate([block, more + block.max() + 1])
    return index, block, row[places[index]]


def windows_of(line: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into places, window) for every window of a line, given by word, that a place lies in."""
    heads = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    of = np.searchsorted(heads, places, "right") - 1
    length = np.diff(np.append(heads, len(line)))
    half = size // 2
    windows = np.where(length <= size, 1, -(-(length - size) // half) + 1)
    first = np.cumsum(windows) - windows
    k = (places - heads[of]) // half
    index, block = [], []
    for back in (0, 1):
        inside = (k - back >= 0) & (k - back < windows[of]) & ~((windows[of] == 1) & (k - back != 0))
        index.append(np.flatnonzero(inside))
        block.append((first[of] + k - back)[inside])
    alone = np.flatnonzero((windows[of] == 1) & (k > 1))
    index.append(alone)
    block.append(first[of][alone])
    return np.concatenate(index), np.concatenate(block)


def block_words(data, begin, row, hashed, templates: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, word number, row), each different word of a block once."""
    places, numbers = templates.numbers(hashed)
    index, block, rows = blocks_of(data, begin, row, places)
    pair = block.astype(np.int64) * max(1, len(templates.vocabulary)) + numbers[index]
    _, one = np.unique(pair, return_index=True)
    return block[one], numbers[index][one], rows[one]


def met(block: np.ndarray, number: np.ndarray, row: np.ndarray, templates: Templates, rank: np.ndarray) -> dict[tuple[int, int], float]:
    """{(row, template): best share} of all blocks that meet a template."""
    out: dict[tuple[int, int], float] = {}
    if not len(block):
        return out
    order = np.lexsort((rank[number], block))
    block, number, row = block[order], number[order], row[order]
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    sizes = np.diff(np.append(heads, len(block)))
    of = np.repeat(np.arange(len(heads)), sizes)
    place_in = np.arange(len(block)) - heads[of]
    for t, members in enumerate(templates.sets):
        needed, size = templates.needed[t], len(members)
        ordered = members[np.argsort(rank[members])]
        position = np.full(len(templates.vocabulary), -1)
        position[ordered] = np.arange(size)
        i = position[number]
        hit = np.flatnonzero((i >= 0) & (i <= size - needed) & (sizes[of] >= needed))  # prefix and length
        if not len(hit):
            continue
        _, first = np.unique(of[hit], return_index=True)
        hit = hit[first]
        reach = 1 + np.minimum(size - 1 - i[hit], sizes[of[hit]] - 1 - place_in[hit])
        for b in of[hit[reach >= needed]]:
            shared = int((i[heads[b] : heads[b] + sizes[b]] >= 0).sum())
            if shared >= needed:
                key = (int(row[heads[b]]), t)
                out[key] = max(out.get(key, 0.0), shared / size)
    return out


def phrase_places(row: np.ndarray, hashed: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the phrase's words begin to stand consecutively in one text."""
    n, k = len(hashed), len(phrase)
    at = np.flatnonzero(hashed[: max(0, n - k + 1)] == phrase[0]) if n >= k else np.zeros(0, np.int64)
    for j in range(1, k):
        at = at[hashed[at + j] == phrase[j]]
    return at[row[at] == row[at + k - 1]]


def scanned(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = SHARE, keep_text: bool = True) -> DataFrame:
    """All rows and columns of `docs` with a struct `_license` of what their texts declare.

    `_license`: n_words; n_base, first_word and last_word, the number of places of the phrases and
    the least and largest of their first words, null without one; base_labels and labels, those of
    the phrases and of all, sorted; score, 1 with a phrase, else the best share of a template met,
    else 0. Null and empty texts declare nothing; repeated rows say the same; an empty table
    gives an empty one. Other columns may have any names but `_license`.
    """
    at = place(docs, text)
    base = numbered(docs)
    own = Templates(templates, share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own.vocabulary), np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(column(batch, "text")):
                begin, _, row, hashed = words(data, bounds)
                total += np.bincount(block_words(data, begin, row, hashed, own)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    seen = base.select(F.col(at).alias("text")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(own.vocabulary), np.int64)
    for word, n in seen.collect():  # a row a word of the templates
        frequency[word] = n
    rank = np.empty(len(frequency), np.int64)
    rank[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))
    named = [(word_hashes(p), label) for p, label in phrases.items()]
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in chunks(column(batch, at)):
                rows = last - first
                begin, _, row, hashed = words(data, bounds)
                total = counts(row, rows)
                starts = np.cumsum(total) - total
                labels: list[set[str]] = [set() for _ in range(rows)]
                n_base, low, high = np.zeros(rows, np.int64), [None] * rows, [None] * rows
                for phrase, label in named:
                    for p in phrase_places(row, hashed, phrase):
                        r, w = int(row[p]), int(p - starts[row[p]])
                        labels[r].add(label)
                        n_base[r] += 1
                        low[r] = w if low[r] is None else min(low[r], w)
                        high[r] = w if high[r] is None else max(high[r], w)
                base_labels = [",".join(sorted(x)) for x in labels]
                score = (n_base > 0).astype(float)
                for (r, t), value in met(*block_words(data, begin, row, hashed, own), own, rank).items():
                    labels[r].add(own.labels[t])
                    score[r] = max(score[r], value)
                part = batch.slice(first, rows)
                kept = [k for k, name in enumerate(part.schema.names) if keep_text or name != at]
                new = [pa.array(total.astype(np.int64)), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(base_labels, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + new, names=[part.schema.names[k] for k in kept] + FIELDS)

    found = base.mapInArrow(scan, _ddl(base, at, keep_text))
    return found.select(*named_back(docs, F.struct(*FIELDS).alias("_license"), skip=() if keep_text else (text,)))


def _ddl(base: DataFrame, at: str, keep_text: bool) -> str:
    own = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema if keep_text or f.name != at]
    return ", ".join(own + [f"{n} {k}" for n, k in zip(FIELDS, KINDS, strict=True)])


def digest(docs: DataFrame) -> DataFrame:
    return scanned(docs.select("doc_id", "text"), keep_text=False).select("doc_id", "_license.*")
