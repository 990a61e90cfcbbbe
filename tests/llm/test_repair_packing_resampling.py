import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
import brute_repair

from gridrisk.llm import conversations, encoding, histogram_packing, resampling

CONVERSATION = "conv_id long, turn long, role string, text string, digest string, conv string"


@pytest.fixture(scope="module")
def talks(spark):
    """Short and long conversations, nulls in any column, blanks, copies, gaps and clashing column names."""
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        n = rng.choice([1, 2, 3, 5, 9, 150] if conv == 7 or conv is None else [1, 2, 3, 5, 9])
        for k in range(n):
            turn = rng.choice([k, k, k, k + 2, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"])
            text = rng.choice(["Yes.", "no", "Well!  \n", " \t", "", None, f"number {k}?", f"open {k}", "日本。", "é."])
            rows += [(conv, turn, role, text, "x", None)] * rng.choice([1, 1, 1, 2, 4])
    rows += [(200, k, ("user", "assistant")[k % 2], f"Turn {k}.", None, "y") for k in range(400)]
    return spark.createDataFrame(rows, CONVERSATION).repartition(5)


@pytest.mark.parametrize("stretch", [conversations.STRETCH, 3])
def test_repairs_against_every_cheapest_path(spark, talks, stretch, monkeypatch):
    # the stretch is bound where the tasks' function is made
    whole = conversations._stretches
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    monkeypatch.setattr(conversations, "TOGETHER", stretch)
    monkeypatch.setattr(conversations, "_stretches", lambda *given: (setattr(conversations, "STRETCH", stretch), whole(*given))[1])
    got = Counter(tuple(r) for r in conversations.digest(talks).collect())
    want = Counter(brute_repair.digests([tuple(r)[:4] for r in talks.collect()]))
    assert got == want


def test_repaired_rows_are_those_of_the_checksum(spark, talks):
    rows, _ = conversations.damaged(talks)
    lines = defaultdict(list)
    for r in conversations.repaired(rows).orderBy("part", "place", "step").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, *_, sha in brute_repair.digests([tuple(r)[:4] for r in talks.collect()]):
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == sha


def test_repair_of_empty_tables_and_given_conversations(spark, talks):
    assert conversations.digest(talks.limit(0)).count() == conversations.repaired(talks.limit(0)).count() == 0
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (2, 0, "assistant", "x"), (3, 0, "system", "Be kind."), (3, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in conversations.repaired(frame).orderBy("part", "place", "step").collect():
        got[r.conv_id].append((r.edit, r.role, r.text))
    # an empty answer costs less than to delete; a lone open answer goes
    assert got == {1: [("K", "user", "Hi."), ("R", "assistant", "There.")], 3: [("K", "system", "Be kind."), ("K", "user", "Hi."), ("I", "assistant", "")]}


def test_auction_prices_are_distances():
    rng = np.random.default_rng(4)
    cost = rng.integers(0, 9, (40, 6, 4, 4))
    cost[rng.random(cost.shape) < 0.3] = conversations.FAR
    rank = np.broadcast_to(np.arange(4), cost.shape)
    layers = rng.integers(1, 7, 40)
    total, paths = conversations.auction(cost, rank, layers)
    for p in range(40):
        best = {(a, a): (0, (a,)) for a in range(4)}
        for k in range(layers[p]):
            ways = defaultdict(list)
            for (a, b), (paid, path) in best.items():
                for c in range(4):
                    if cost[p, k, b, c] < conversations.FAR:
                        ways[a, c].append((paid + int(cost[p, k, b, c]), (*path, c)))
            best = {key: min(found) for key, found in ways.items()}
        for a in range(4):
            for b in range(4):
                if (a, b) in best:
                    assert (total[p, a, b], tuple(paths[p, a, b, : layers[p] + 1])) == best[a, b]
                else:
                    assert total[p, a, b] == conversations.FAR


def test_encoder_is_the_library(tokenizer, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r", "\xa0", "　", "\x1c", "\x85", " ", "a", "Bc", "'s", "'", ".", ",", "...", "12", "é", "日本", "🙂", "\x01", "<|endoftext|>", "​", "﻿", " a", " the", "?."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20000)] + [None, "", "x" * 5000] + [r.text for r in small.collect()]
    got = []
    for kind in (pa.string(), pa.large_string()):
        got = [ids[a:b].tolist() for _, ids, bounds in encoding.encoded(pa.array(texts, kind), tokenizer) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert got == [x.ids for x in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_histogram_packing_against_the_library(spark, odd, small, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    for frame in (small, odd):
        want = Counter()
        for x in frame.collect():
            ids = [*library.encode(x.text or "", add_special_tokens=False).ids, 1]
            head = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
            cuts = [0, *range(head, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[x.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), len(ids)] += 1
        rows = histogram_packing.digest(frame, tokenizer).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
            assert sum(n for _, n in parts) <= 2048
        assert set(sequences) == set(range(len(sequences)))
        assert len(sequences) == plain_best_fit([r.length for r in rows])
    assert histogram_packing.digest(odd.limit(0), tokenizer).count() == 0


def plain_best_fit(lengths, limit=2048):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(limit - n)
    return len(rooms)


def test_plan_of_counts_is_best_fit_of_documents():
    rng = np.random.default_rng(6)
    for most, limit in ((40, 64), (64, 64), (3, 10), (200, 256)):
        lengths = rng.integers(1, most + 1, 300)
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        plan = histogram_packing.best_fit(counts, limit)
        assert plan.sequences == plain_best_fit(lengths.tolist(), limit)
        used = np.zeros((plan.sequences, limit), int)
        for n, count in counts.items():
            sequence, offset = histogram_packing.slots(plan, np.full(count, n), np.arange(count))
            for s, o in zip(sequence, offset, strict=True):
                used[s, o : o + n] += 1
        assert used.max() == 1 and (np.diff(used, axis=1) <= 0).all()
    # the plan does not grow with the counts
    assert len(histogram_packing.best_fit({n: 10**12 for n in range(1, 2049)}).rank) < 20_000


def features(text):
    w = brute.words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled(docs, bench):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for r in rows for f in features(r.text)) for rows in (docs, bench))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for r in docs:
        own = features(r.text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute.words(r.text)) >= 20])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


def test_resampling_against_a_plain_sort(spark, odd, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    long_words = spark.createDataFrame([(9, ("x" * 200 + " ") * 30 + "é" * 70 + " end"), (10, None), (-5, "a b " * 40)], "doc_id long, text string")
    for frame in (small, odd, small.select("doc_id", "text").union(long_words).union(small.select("doc_id", "text").limit(50))):
        got = Counter(tuple(r) for r in resampling.digest(frame, bench).collect())
        assert got == resampled(frame.collect(), bench.collect())
    assert resampling.digest(odd.limit(0), bench).count() == 0
    assert resampling.digest(odd, bench.limit(0)).where("rank is not null").count() == 1


def test_radix_passes_over_small_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 3, 900, 2**40 + 5]), rng.choice([0, 1, 2**33, 77]), k, 10**10 * (k // 100) + k % 3, k) for k in range(1000)]
    frame = spark.createDataFrame(rows, "high long, low long, number long, block long, pos long").repartition(4)
    got = resampling.radix_ranked(frame, "high", "low", 41, 34, bits=5, block_rows=64).collect()
    ordered = sorted(got, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(1000))
    assert [(r.high, r.low) for r in ordered] == sorted((r.high, r.low) for r in got)
    # stable: equal keys stay in the order of block and place
    places = {r[2]: (r[3], r[4]) for r in rows}
    for a, b in zip(ordered, ordered[1:], strict=False):
        assert (a.high, a.low) < (b.high, b.low) or places[a.number] < places[b.number]
