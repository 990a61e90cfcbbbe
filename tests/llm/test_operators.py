import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from math import ceil
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from gridrisk.llm import contamination, graph, licenses, near_duplicates, packing, privacy, quality, sentences, sharding, suffixes, tokens




def test_odd_input_and_empty_tables(spark, odd, tokenizer):
    bench = spark.createDataFrame([(1, "fox jumps over the lazy dog while seven wizards quietly boxed"), (2, None), (None, "zinc"), (1, "zinc")], "item_id long, text string")
    empty = odd.limit(0)
    rows = odd.count()
    for frame, n in ((odd, rows), (empty, 0)):
        assert licenses.scanned(frame).count() == n
        assert suffixes.without_repeats(frame).count() == n
        assert privacy.private_spans(frame).count() == n
        assert quality.judged(frame).count() == n
        assert near_duplicates.digest(frame).count() == n
        assert sentences.without_repeats(frame).count() == n
        assert tokens.digest(frame, tokenizer).count() == n
        assert sharding.digest(frame).count() == n
        assert contamination.contamination(frame, bench).count() == n
        assert packing.packed_texts(frame, tokenizer).select("doc_id").distinct().count() == (8 + 1 if n else 0)
    assert licenses.scanned(odd).columns == [*odd.columns, "_license"]
    assert contamination.decontaminated(odd, bench).columns == odd.columns
    assert privacy.sanitised(odd).columns == odd.columns
    assert quality.passing(odd).columns == odd.columns
    assert near_duplicates.one_of_each(odd).columns == odd.columns
    found = {(r.doc_id, r.n_email, r.n_phone) for r in privacy.digest(odd).collect()}
    assert (2, 1, 1) in found
    assert contamination.digest(odd, bench.limit(0)).where("contaminated").count() == 0


def test_licenses_against_all_blocks(small, odd):
    for frame in (small, odd):
        got = Counter(tuple(r) for r in licenses.digest(frame).collect())
        want = Counter()
        templates = [(label, set(t.split())) for label, t in licenses.TEMPLATES]
        for x in frame.collect():
            w, places, base = brute.words(x.text), [], set()
            for phrase, label in licenses.PHRASES.items():
                p = phrase.split()
                at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
                places += at
                base |= {label} if at else set()
            labels, score = set(base), 1.0 if places else 0.0
            for line in brute.lowered(x.text).split("\n"):
                own = brute.words(line)
                windows = [own] if len(own) <= 64 else [own[k : k + 64] for k in range(0, 32 * (ceil((len(own) - 64) / 32) + 1), 32)]
                for block in map(set, windows):
                    for label, t in templates:
                        if len(block & t) >= ceil(licenses.SHARE * len(t) - 1e-9):
                            labels.add(label)
                            score = max(score, len(block & t) / len(t))
            want[(x.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)] += 1
        assert got == want


def test_licenses_wrapped_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files"
    far = "\n".join(f"filler{k} line{k} of{k} text{k}" for k in range(60))
    docs = spark.createDataFrame([(1, bsd), (2, f"{far}\n{mit}\n{far}"), (3, far)], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score) for r in licenses.digest(docs).collect()} == {1: ("bsd", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 1])
def test_suffixes_against_all_windows(small, odd, crowded, monkeypatch):
    whole = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda rows: whole(rows, crowded))
    for frame in (small, odd):
        rows, seen = frame.collect(), Counter()
        for x in rows:
            raw = (x.text or "").encode()
            seen.update(raw[i : i + 200] for i in range(len(raw) - 199))
        want = Counter()
        for x in rows:
            raw = (x.text or "").encode()
            gone = np.zeros(len(raw), bool)
            for i in range(len(raw) - 199):
                if seen[raw[i : i + 200]] > 1:
                    gone[i : i + 200] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)
            kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
            want[(x.doc_id, len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())] += 1
        assert Counter(tuple(r) for r in suffixes.digest(frame).collect()) == want


def test_interleaving_is_the_order_of_the_suffixes():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, interval = suffixes.interleaved(columns)
    told = list(zip(*(c[order].tolist() for c in columns), strict=True))
    assert told == sorted(told)
    assert [a != b for a, b in zip(told, told[1:], strict=False)] == (np.diff(interval) > 0).tolist()


def test_packing_covers_every_id_once(odd, small, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    for frame in (small, odd):
        want = Counter()
        for x in frame.collect():
            ids = np.array(library.encode(x.text or "", add_special_tokens=False).ids + [1], "<u4")
            want[(x.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        pieces = packing.packed_texts(frame, tokenizer, keep_ids=True).collect()
        sequences, docs = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert p.length * 4 == len(p.ids) and zlib.crc32(p.ids) == p.ids_crc32
            sequences[p.sequence_id].append((p.offset, p.length))
            docs[(p.doc_id, p.doc_tokens)].append(p)
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
            assert sum(n for _, n in parts) <= 2048 and len(parts) <= packing.SEGMENTS
        short = sum(2048 - sum(n for _, n in parts) for parts in sequences.values())
        assert short <= 2048
        for (doc, total), parts in docs.items():
            copies = sum(n for (d, t, _), n in want.items() if (d, t) == (doc, total))
            assert sum(p.length for p in parts) == copies * total
            if copies == 1:
                ids = b"".join(p.ids for p in sorted(parts, key=lambda p: p.start))
                assert want[(doc, total, zlib.crc32(ids))] == 1


def test_packing_holds_three_limits():
    rng = np.random.default_rng(2)
    pieces = [packing.Piece((k, 0), 0, np.zeros(n, np.uint32), rng.random(n) < 0.5) for k, n in enumerate(rng.integers(1, 300, 400))]
    limits = (512, 6, 200)
    done, open_ = packing.pack_pool(pieces, limits, final=True)
    assert not open_
    for sequence in done:
        total = np.sum([p.demand() for p in sequence], axis=0)
        assert (total <= limits).all()
    assert sum(len(p.ids) for s in done for p in s) == sum(len(p.ids) for p in pieces)
    bound = max(sum(p.demand()[d] for s in done for p in s) / limits[d] for d in range(3))
    assert len(done) <= 1.1 * bound + 2


def test_private_spans_against_patterns(small, odd, spark):
    tricky = spark.createDataFrame([(1, "a@b.c.d x@y 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 +1 (234) 567-8901 4111 1111 1111 1111 4111-1111-1111-1112 +12 " + "9" * 5000 + " " + "a." * 3000 + "@q.r"), (2, "é🙂 z.z@q.example end")], "doc_id long, text string")
    for frame in (small, odd, tricky):
        want = Counter()
        for x in frame.collect():
            spans = brute.private(x.text)
            line = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
            want[(x.doc_id, *[len(v) for v in spans.values()], hashlib.sha256(line.encode()).hexdigest())] += 1
        assert Counter(tuple(r)[:-1] for r in privacy.digest(frame).collect()) == want
    assert privacy.digest(privacy.sanitised(small)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(k, f"note {k} call zorblax at ann@corp.example today number {k}") for k in range(6)]
    rows += [(100 + k, f"call number {k} today at the note with other words") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in privacy.digest(docs).collect()}
    text = dict(rows)[0]
    at = text.index("zorblax")
    assert f"term:{at}:{at + 7}" in found[0] and f"term:{text.index('call')}:" not in found[0]
    assert all(found[k] == "" for k in found if k >= 100)
    assert privacy.sanitised(docs).where("doc_id = 0").first().text == text.replace("zorblax", "[TERM]").replace("ann@corp.example", "[EMAIL]")


def test_terms_of_rare_entities_and_copied_texts(spark):
    far = "call number and note with other words " * 4
    rows = [(1, f"the address ann@corp.example {far} belongs to quixley"), (2, f"quixley wrote a note with number {far}")]
    rows += [(10 + k, f"call bob@corp.example number {'abcdef'[k % 3] * 4} with zorblax note") for k in range(3)]
    rows += [(20, rows[2][1])] * 100
    rows += [(200 + k, f"the address belongs to other words and note with call number wrote {'ghijkl'[k % 6] * (3 + k // 6)}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.doc_id: {s.value for s in r._spans if s.kind == "term"} for r in privacy.private_spans(docs).collect()}
    # in one text with its entity and in one without; then one in all three texts, one of them copied 100 times
    assert terms[1] == {"quixley"} and terms[2] == {"quixley"}
    assert all("zorblax" in terms[k] for k in (10, 11, 12, 20))
    assert not any(terms[200 + k] for k in range(100))


def quality_counts(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    covered = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(small, odd):
    for frame in (small, odd):
        want, got = Counter(), Counter()
        for x in frame.collect():
            counts = quality_counts(x.text)
            want[(x.doc_id, *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])] += 1
        for r in quality.digest(frame).collect():
            got[tuple(r)[:-1]] += 1
            assert not (r.kept and r.base_failed)
        assert got == want


def test_cutoffs_follow_the_group_and_fall_back(spark):
    clean = [(f"plain{k} " * 3 + "one two three four five six seven eight nine ten eleven twelve ends here now with some more of them to come", "en", "a") for k in range(300)]
    marked = [(f"plain{k} # one # two # three # four # five # six # seven # eight # nine ten eleven twelve ends here with some more of them to come", "en", "code") for k in range(300)]
    odd_one = [("word# next# other# thing# more# stuff# again# yet# still# some# last# words# here# and# then# it# ends# right# about# now#", "en", "a")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(clean + marked + odd_one)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.digest(docs).collect()}
    assert all(kept[k] for k in range(600)) and not kept[600]


def test_cutoffs_are_tighter_where_the_group_is(spark):
    plain = [" ".join(f"{w}{k}" for w in "some quite plain prose with words that nobody says twice over here since every single word has its number".split()) + f" end{k}" for k in range(300)]
    words = [f"word{k}" for k in range(100)]
    bad = [
        " ".join(words) + " #" * 20,  # 20 symbols for 100 words
        " ".join([*words, *words[:12]]),  # a fifth of it in repeated windows
        " ".join("ab"[k % 2] + "cdefgh"[k % 6] for k in range(60)),  # short words
    ]
    docs = spark.createDataFrame([(k, x, "en", "a") for k, x in enumerate(plain + bad)], "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r._quality for r in quality.judged(docs).collect()}
    assert all(found[k].kept for k in range(300)) and not any(found[k].kept for k in (300, 301, 302))
    assert not found[300].base_failed and not found[301].base_failed


def reference_classes(rows):
    shingles, postings = {}, defaultdict(set)
    for k, x in enumerate(rows):
        w = brute.words(x.text)
        shingles[k] = [tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))] if w else []
        for s in set(shingles[k]):
            postings[s].add(k)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    texts = {}
    pairs = {(a, b) for p in postings.values() for a in p for b in p if a < b}
    pairs |= {(texts.setdefault(x.text or "", k), k) for k, x in enumerate(rows)}
    for a, b in pairs:
        if a == b:
            continue
        same = (rows[a].text or "") == (rows[b].text or "")
        if not same:
            total = len(shingles[a]) + len(shingles[b])
            most = sum((Counter(shingles[a]) & Counter(shingles[b])).values())
            if most < 0.8 * (total - most) - 1e-9:
                continue
            m = brute.alignment(shingles[a], shingles[b])
            same = m >= 0.8 * (total - m) - 1e-9
        if same:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k, x in enumerate(rows):
        groups[find(k)].append(x.doc_id)
    return Counter(tuple(sorted(g, key=lambda v: (v is not None, v or 0))) for g in groups.values())


def test_near_duplicates_behind_a_common_passage(spark):
    """Texts that share a passage and are unlike, among them three pairs that only late rounds can meet."""
    passage = " ".join(f"p{k}" for k in range(30))
    made = [(k, f"{passage} " + " ".join(f"t{k}x{j}" for j in range(12))) for k in range(42)]
    made += [(100 + k, made[k][1] + " more") for k in (3, 20, 41)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    groups = defaultdict(list)
    for r in near_duplicates.digest(frame).collect():
        groups[r.class_id].append(r.doc_id)
    want = reference_classes(frame.collect())
    assert Counter(tuple(sorted(g)) for g in groups.values()) == want
    assert sorted(g for g in want if len(g) > 1) == [(3, 103), (20, 120), (41, 141)]


def test_near_duplicates_over_a_bridge_of_low_rank(spark):
    # key 1 holds first, other and bridge in this order of degrees; only the bridge is like both
    whole = np.arange(100, dtype="<u4")
    rows = [
        ("first", [1, 2], whole[15:]),
        ("other", [1, 3], whole[:85]),
        ("bridge", [1], whole),
        *[(f"x{k}", [2], np.arange(1000 * k, 1000 * k + 85, dtype="<u4")) for k in (1, 2)],
        ("x3", [3], np.arange(5000, 5085, dtype="<u4")),
    ]
    sketches = spark.createDataFrame([(n, k, bytearray(s.tobytes())) for n, k, s in rows], "node string, keys array<long>, seq binary")
    assert near_duplicates.aligned(whole[15:], whole[:85]) < 0.8
    roots = {r.node: r.root for r in near_duplicates.text_classes(sketches).collect()}
    assert roots == dict.fromkeys(("first", "other", "bridge"), "bridge")


def test_near_duplicates_against_all_pairs(small, odd, spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    made = []
    for k in range(30):
        copy = list(base)
        for at in rng.integers(0, len(copy), k // 6):
            copy[at] = f"edit{k}x{at}"
        made.append((k, " ".join(copy)))
    copies = spark.createDataFrame(made, "doc_id long, text string")
    for frame in (small, copies, odd.where("length(text) < 5000 or text is null")):
        rows = near_duplicates.digest(frame).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[r.class_id, r.class_rows].append(r.doc_id)
        if frame is not odd:
            assert sum(r.kept for r in rows) == near_duplicates.one_of_each(frame).count()
        want = reference_classes(frame.collect())
        assert sum(r.kept for r in rows) == sum(want.values())
        got = defaultdict(list)
        for r in rows:
            got[r.class_id].append(r.doc_id)
        if frame.where("doc_id is null").count() == 0:
            assert Counter(tuple(sorted(g)) for g in got.values()) == want


def test_banded_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint32)
        b = a.copy() if rng.random() < 0.6 else rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint32)
        b = np.delete(b, rng.integers(0, len(b), min(len(b) - 1, int(rng.integers(0, 4)))))
        m = brute.alignment(a.tolist(), b.tolist())
        want = m / (len(a) + len(b) - m)
        got = near_duplicates.aligned(a, b)
        assert (got >= 0.8) == (want >= 0.8 - 1e-9)
        if want >= 0.8:
            assert got == pytest.approx(want)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8)], "a long, b long")
    assert {tuple(r) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_sentences_against_all_runs(small, odd):
    for frame in (small, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(frame.collect(), key=lambda x: x.doc_id)
        own, gone, seen = {}, defaultdict(set), defaultdict(list)
        for x in rows:
            text = x.text or ""
            cuts = [0, *sorted({m.end() for m in re.finditer(r"\n|(?<=[.!?]) ", text)}), len(text)]
            own[x.doc_id] = [(a, b, brute.words(text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if brute.words(text[a:b])]
            for i in range(len(own[x.doc_id])):
                for size, least in sentences.RUNS:
                    run = own[x.doc_id][i : i + size]
                    w = tuple(v for s in run for v in s[2])
                    if len(run) == size and len(w) >= least:
                        seen[w].append((x.doc_id, i, size))
        for places in seen.values():
            first = min(places)[:2]
            for doc, i, size in places:
                if (doc, i) != first:
                    gone[doc].update(range(i, i + size))
        got = {r.doc_id: (r.n_sentences, r.n_removed, r.kept_sha256) for r in sentences.digest(frame).collect()}
        for x in rows:
            text, here, kept = x.text or "", 0, ""
            for i in sorted(gone[x.doc_id]):
                a, b, _ = own[x.doc_id][i]
                kept, here = kept + text[here:a], b
            kept += text[here:]
            assert got[x.doc_id] == (len(own[x.doc_id]), len(gone[x.doc_id]), hashlib.sha256(kept.encode()).hexdigest())


def test_token_files_round_trip(small, odd, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    for frame in (small, odd):
        at, want = 0, Counter()
        rows = sorted(frame.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))
        for x in rows:
            ids = library.encode(x.text or "", add_special_tokens=False).ids + [0]
            want[(x.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
            at += len(ids)
        assert Counter(tuple(r) for r in tokens.digest(frame, tokenizer).collect()) == want


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        for high in (1, 2, 50257, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[: n // 50] = (1 << 32) - 1
            data = tokens.pack(ids)
            assert (tokens.unpack(data) == ids).all()
            assert (tokens.unpack(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_encoder_at_white_space(tokenizer):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    for text in ("", " ", "  a  b ", "a\n b", " \t x", "x  y　", "don't  'll  ", "<|endoftext|> a <|endoftext|>b", "é  è\n\n  ü", "\x1c a \x85 b ", "a 1 2,3 4."):
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        assert list(tokens.encoded(pa.array([text]), tokenizer)) == [(0, ids.tobytes())]


def test_shards_are_a_permutation(spark, small, odd):
    for frame in (small, odd, spark.range(1).selectExpr("id as doc_id", "'x' as text"), spark.range(1201).selectExpr("5L as doc_id", "'x' as text")):
        rows = sharding.digest(frame).collect()
        n = len(rows)
        assert sorted(r.position for r in rows) == list(range(n)) == sorted(r.row_number for r in rows)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert 0 <= r.shard < 40
        sizes = [len(slots[s]) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        again = sharding.digest(frame.repartition(5)).collect()
        assert Counter(tuple(r)[:7] for r in rows) == Counter(tuple(r)[:7] for r in again)


def test_cycle_walking_ends():
    for n in (1, 2, 3, 7, 1000, 999_983, 10**11 + 7):
        a, b = sharding.domain(n)
        assert n <= a * b <= n + 64


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(6)
    for n, sigma in ((1, 3), (50, 3), (400, 5), (3000, 700)):
        text = np.append(rng.integers(1, sigma, n), 0)
        index = contamination.FMIndex(text)
        patterns = np.unique(np.stack([text[k : k + 3] for k in range(max(1, n - 3))] if n > 3 else [np.array([1, 1, 1])]), axis=0)
        which, low, high = index.search(patterns)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
        for k, p in enumerate(patterns):
            places = [j for j in range(n - 2) if (text[j : j + 3] == p).all()]
            assert found.get(k, []) == places


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 3000])
def test_contamination_against_all_windows(spark, small, block_bytes):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = defaultdict(set)
    for x in bench.collect():
        w = brute.words(x.text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            items[tuple(w[k : k + size])].add(str(x.item_id))
    got = {r.doc_id: r._hits for r in contamination.contamination(small, bench, block_bytes=block_bytes).collect()}
    for x in small.collect():
        w, hit, names = brute.words(x.text), set(), set()
        for size in {len(k) for k in items}:
            for k in range(len(w) - size + 1):
                owners = items.get(tuple(w[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    names |= owners
        assert (got[x.doc_id].n_words, got[x.doc_id].n_hit, got[x.doc_id]["items"]) == (len(w), len(hit), sorted(names))
    clean = contamination.decontaminated(small, bench)
    assert contamination.digest(clean, bench).where("contaminated").count() == 0
