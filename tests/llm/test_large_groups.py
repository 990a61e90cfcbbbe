"""Groups of many texts that share keys or grams and are unlike each other."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from test_operators import reference_classes

from gridrisk.llm import near_duplicates, suffixes


def test_unlike_texts_of_a_key_are_not_paired(spark, monkeypatch):
    """Every 3 of 11 words of a text changed: all share shingles, none is like another but for eight copies."""
    texts = []
    for changed in combinations(range(11), 3):
        words = [f"w{k}" for k in range(60)]
        for k in changed:
            words[5 * k + 4] = f"edit{k}"
        texts.append(" ".join(words))
    made = list(enumerate(texts)) + [(1000 + k, texts[20 * k] + " more") for k in range(8)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    paired, whole = [], near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, *rest: paired.append(pairs.count()) or whole(pairs, *rest))
    monkeypatch.setattr(near_duplicates, "LARGE", 2, raising=False)
    monkeypatch.setattr(near_duplicates, "BLOCK", 20, raising=False)
    groups = defaultdict(list)
    for r in near_duplicates.digest(frame).collect():
        groups[r.class_id].append(r.doc_id)
    want = reference_classes(frame.collect())
    assert Counter(tuple(sorted(g)) for g in groups.values()) == want
    assert sum(len(g) > 1 for g in want) == 8
    assert sum(paired) <= near_duplicates.FUNCTIONS * len(made)


def test_forest_links_what_is_alike_once():
    """A block of copies gives one link less than it has texts, whatever it was dealt with."""
    base = np.arange(200, dtype="<u4")
    seqs = [np.delete(base, k) for k in range(40)] + [base + 1000 * k for k in range(1, 6)]
    side = [{"node": f"n{k}", "root": f"n{k}", "rank": k + 1, "live": True, "seq": x.tobytes()} for k, x in enumerate(seqs)]
    links = near_duplicates.forest(side, side, 0.8)
    assert len(links) == 39 and {x for link in links for x in link} == {f"n{k}" for k in range(40)}
    for x in side[:40]:
        x["root"] = "n0"
    assert near_duplicates.forest(side, side, 0.8) == []
    want = np.array([[len(np.intersect1d(a, b)) for b in seqs] for a in seqs])
    assert (near_duplicates.overlaps(seqs, seqs) == want).all()
    twice = [np.array([7, 7, 7, 8], "<u4"), np.array([7, 7, 9], "<u4")]
    assert near_duplicates.overlaps(twice, twice).tolist() == [[4, 2], [2, 3]]


def test_a_gram_in_many_surroundings_is_not_dealt_window_by_window(spark):
    """A line of 120 bytes in 150 texts, and one of 260 in as many: far fewer parts than windows are made."""
    rng = np.random.default_rng(7)

    def letters(n):
        return "".join(chr(97 + k) for k in rng.integers(0, 26, n))

    line, long = letters(120), letters(260)
    texts = [letters(150) + (line, long)[k % 2] + letters(150) for k in range(300)]
    texts += [texts[10][40:] + letters(30), letters(20) + texts[11][:330]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    staged, whole = {}, suffixes.cut_lineage

    def cut(df, name="stage"):
        out = whole(df, name)
        staged[name] = staged.get(name, 0) + out.count()
        if name == "suffix-pieces":
            staged["windows"] = out.where("crowd > 20").agg({"size": "sum"}).first()[0]
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "cut_lineage", cut)
        repeats = suffixes.repeated_spans
        patch.setattr(suffixes, "repeated_spans", lambda rows: repeats(rows, 20))
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.digest(frame).collect()}
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for k, text in enumerate(texts):
        covered = np.zeros(len(text) + 2, int)
        for at in range(len(text) - 199):
            if seen[text[at : at + 200]] > 1:
                covered[at + 1 : at + 201] = 1
        assert got[k] == (covered.sum(), (np.diff(covered) == 1).sum())
    assert 0 < 4 * staged["suffix-parts"] <= staged["windows"]
