"""Near-duplicate texts by Order MinHash, verified by banded alignment of their word shingles.

Shingles of five words carry the number of their earlier occurrences in the text. For each of a
dozen hash functions the two least labelled shingles, put in the order in which the text has them,
make one key; texts that share a key are candidates. Texts of a key meet its hub, the one with the
most partners over all keys; those that the links so far do not connect with it meet further texts
of the key, round by round. A group of copies ends after its hub and is never expanded into pairs;
in a large group the texts left meet block by block, and a block gives links of a forest alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.graph import components
from gridrisk.llm.text import chunks, column, long_list, mix, named_back, numbered, place, words
from gridrisk.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
FUNCTIONS = 12  # at similarity 0.8 a pair shares no key once in 200,000 pairs
GROWTH = 4096  # times more leading texts of a key in each round
LARGE = 32  # texts of a key, beyond which they meet in blocks after the first round
BLOCK = 512  # texts of a block
BLOCK_BYTES = 1 << 20  # of the shingles of a block
TOKENS = 4096  # different shingles that are counted at once for two blocks

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingled(row: np.ndarray, hashed: np.ndarray, rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `size` words in order; a row of fewer words has one, of none none."""
    total = np.bincount(row, minlength=rows)
    first = np.cumsum(total) - total
    number = np.where(total == 0, 0, np.maximum(total - size + 1, 1))
    of = np.repeat(np.arange(rows), number)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    out = np.full(len(of), np.uint64(size))
    stop = (first + total)[of]
    for k in range(size):
        inside = at + k < stop
        word = hashed[np.minimum(at + k, max(len(hashed) - 1, 0))] if len(hashed) else out
        out = np.where(inside, mix(out * _FACTOR + word), out)
    return of, out


def labelled(of: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Shingles mixed with the number of equal ones before them in the same row."""
    if not len(of):
        return shingles
    key = mix(shingles + of.astype(np.uint64) * _FACTOR)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    before = np.empty(len(of), np.uint64)
    before[order] = np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))
    return mix(shingles + before * np.uint64(0xD6E8FEB86659FD93))


def order_minhash(of: np.ndarray, shingles: np.ndarray, rows: int, functions: int = FUNCTIONS) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, their keys by function): the two least labelled shingles in text order."""
    total = np.bincount(of, minlength=rows)
    some = np.flatnonzero(total)
    if not len(some):
        return some, np.zeros((0, functions), np.uint64)
    first = (np.cumsum(total) - total)[some]
    sizes = total[some]
    labels = labelled(of, shingles)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    keys = np.empty((len(some), functions), np.uint64)
    group = np.repeat(np.arange(len(some)), sizes)
    for j in range(functions):
        value = mix(labels ^ np.uint64(0xA24BAED4963EE407 * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF))
        least = np.minimum.reduceat(value, first)
        at = np.flatnonzero(value == least[group])
        one = np.zeros(len(some), np.int64)
        one[group[at[::-1]]] = at[::-1]
        value[one] = most
        second = np.minimum.reduceat(value, first)
        at = np.flatnonzero(value == second[group])
        two = np.zeros(len(some), np.int64)
        two[group[at[::-1]]] = at[::-1]
        a, b = shingles[np.minimum(one, two)], shingles[np.maximum(one, two)]
        single = sizes == 1
        keys[:, j] = mix(mix(a + np.uint64(j + 1)) * _FACTOR + np.where(single, np.uint64(0), b))
    return some, keys


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Share of two shingle sequences that a banded alignment matches: matches / (both - matches).

    0 if the multisets already show that `similarity` is out of reach. The band is as wide as a
    pair of that similarity can need, so no pair that reaches it is missed.
    """
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = len(a) + len(b)
    needed = similarity * both / (1 + similarity)
    values, first = np.unique(a, return_counts=True)
    others, second = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    if np.minimum(first[x], second[y]).sum() < needed - 1e-9:
        return 0.0
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    matches = head + tail + banded_matches(a, b, int(both - 2 * needed) + 1)
    return matches / (both - matches)


def banded_matches(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of a and b whose pairs lie at most `band` apart, bits for places in b."""
    if not a or not b:
        return 0
    at: dict[int, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row, near = full, (1 << (2 * band + 1)) - 1
    for k, x in enumerate(a):
        here = at.get(x, 0)
        if here:
            here &= near << (k - band) if k >= band else near >> (band - k)
            both = row & here
            row = ((row + both) | (row - both)) & full
    return len(b) - row.bit_count()


def sketched(docs: DataFrame, text: str) -> DataFrame:
    """The rows with `keys`, their Order MinHash keys, and `seq`, their shingles as 64-bit numbers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in chunks(column(batch, text)):
                rows = last - first
                _, _, row, hashed = words(data, bounds)
                of, shingles = shingled(row, hashed, rows)
                some, keys = order_minhash(of, shingles, rows)
                sizes = np.zeros(rows, np.int64)
                sizes[some] = keys.shape[1]
                cuts = np.searchsorted(of, np.arange(rows + 1))
                short = (shingles >> np.uint64(32)).astype("<u4")
                seq = pa.array([short[cuts[k] : cuts[k + 1]].tobytes() for k in range(rows)], pa.binary())
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, long_list(keys.view(np.int64).ravel(), sizes), seq], names=[*batch.schema.names, "keys", "seq"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(sketch, f"{schema}, keys array<bigint>, seq binary")


def verified(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, hub) with `alike`: whether their alignment reaches the similarity."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [aligned(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), similarity) >= similarity - 1e-9 for a, b in zip(column(batch, "seq").to_pylist(), column(batch, "hub_seq").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), column(batch, "hub"), pa.array(alike)], names=["node", "hub", "alike"])

    hubs = sequences.select(F.col("node").alias("hub"), F.col("seq").alias("hub_seq"))
    both = pairs.join(sequences, "node").join(hubs, "hub")
    return both.select("node", "hub", "seq", "hub_seq").mapInArrow(align, "node string, hub string, alike boolean")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each text of a shares with each of b, as multisets."""

    def tokens(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        return of, labelled(of, np.concatenate(texts).astype(np.uint64))

    (of_a, in_a), (of_b, in_b) = tokens(a), tokens(b)
    common = np.intersect1d(in_a, in_b)
    inside = [np.isin(x, common) for x in (in_a, in_b)]
    of_a, of_b = of_a[inside[0]], of_b[inside[1]]
    at_a, at_b = np.searchsorted(common, in_a[inside[0]]), np.searchsorted(common, in_b[inside[1]])
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(common), TOKENS):
        part = []
        for rows, of, at in ((len(a), of_a, at_a), (len(b), of_b, at_b)):
            here = (at >= first) & (at < first + TOKENS)
            has = np.zeros((rows, min(TOKENS, len(common) - first)), np.float32)
            has[of[here], at[here] - first] = 1
            part.append(has)
        out += part[0] @ part[1].T
    return out


def forest(left: list[dict], right: list[dict], similarity: float) -> list[tuple[str, str]]:
    """Links (node, hub) between texts of two blocks that connect all that are alike and are not connected yet.

    `rank` and `live` say who meets whom, as in `text_classes`; the texts of a root are connected.
    """
    a, b = ([np.frombuffer(x["seq"], "<u4") for x in side] for side in (left, right))
    size_a, size_b = (np.array([len(x) for x in side]) for side in (a, b))
    needed = similarity * (size_a[:, None] + size_b[None, :]) / (1 + similarity)
    late = np.iinfo(np.int64).max
    rank = np.array([late if x["rank"] is None else x["rank"] for x in left])[:, None]
    hub_rank, idle = np.array([x["rank"] for x in right]), np.array([not x["live"] for x in right])
    meets = (rank > hub_rank) | (rank < hub_rank) & idle
    names: dict[str, int] = {}
    root_a, root_b = ([names.setdefault(x["root"], len(names)) for x in side] for side in (left, right))
    meets &= np.array(root_a)[:, None] != np.array(root_b)[None, :]
    if not meets.any():
        return []
    parent, links = list(range(len(names))), []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i, j in np.argwhere(meets & (overlaps(a, b) >= needed - 1e-9)).tolist():
        x, y = find(root_a[i]), find(root_b[j])
        if x != y and aligned(a[i], b[j], similarity) >= similarity - 1e-9:
            parent[x] = y
            links.append((left[i]["node"], right[j]["node"]))
    return links


def block_links(texts: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """Links (node, hub) between texts and hubs of a key, a forest for each two blocks of them.

    Both have key, parts, node, rank, live, root and seq; a side of a key is dealt into as many
    blocks as `parts` says. Every block of texts meets every block of hubs in a task of its own.
    """

    def blocks(side: DataFrame, own: str, other: str) -> DataFrame:
        held = side.withColumn(own, F.pmod(F.xxhash64("node"), F.col("parts")))
        held = held.groupBy("key", "parts", own).agg(F.collect_list(F.struct("node", "rank", "live", "root", "seq")).alias("texts"))
        held = held.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        # both sides may come from one table: each has columns of its own
        return held.select(*[F.col(c).alias(c) for c in ("key", "_a", "_b", "texts")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        links = [
            link
            for a in (column(left, "texts").to_pylist() if len(left) else ())
            for b in (column(right, "texts").to_pylist() if len(right) else ())
            for link in forest(a, b, similarity)
        ]
        return pa.table({"node": pa.array([x[0] for x in links], pa.string()), "hub": pa.array([x[1] for x in links], pa.string())})

    by = ["key", "_a", "_b"]
    return blocks(texts, "_a", "_b").groupBy(*by).cogroup(blocks(hubs, "_b", "_a").groupBy(*by)).applyInArrow(meet, "node string, hub string")


def own_shingles(sequences: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a text stand in no other of the texts; id is a hash of node.

    Texts without such shingles have no row.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs = column(batch, "id").to_numpy(), column(batch, "seq").to_pylist()
            sizes = np.array([len(x) // 4 for x in seqs], np.int64)
            part = np.cumsum(sizes) >> 20
            for k in np.unique(part):
                rows = np.flatnonzero(part == k)
                shingles = np.frombuffer(b"".join(seqs[x] for x in rows), "<u4").view("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], sizes[rows])), pa.array(shingles)], names=["id", "shingle"])

    places = sequences.select(F.xxhash64("node").alias("id"), "seq").mapInArrow(listed, "id bigint, shingle int")
    counted = places.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count("*").alias("n"))
    return counted.where(F.col("id") == F.col("last")).groupBy("id").agg(F.sum("n").alias("own"))


def reachable(texts: DataFrame, own: DataFrame | None, similarity: float) -> DataFrame:
    """The rows with `shared`, the length without shingles of their own, where that may still do."""
    if own is None:
        return texts.withColumn("shared", F.col("length"))
    joined = texts.withColumn("id", F.xxhash64("node")).join(own, "id", "left")
    shared = joined.withColumn("shared", F.col("length") - 4 * F.coalesce("own", F.lit(0))).drop("id", "own")
    return shared.where(F.col("shared") >= (similarity - 1e-9) * F.col("length"))


def text_classes(sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) for the nodes that have a near-duplicate, from rows of node, keys and seq.

    Round by round the 1, 4096, 4096 * 4096, ... leading texts of each key meet the texts of the key,
    ranked above or below them, that are not yet in the component of the first. A key is done when
    all its texts are in that component or have met every other, those in the component too; texts
    of a key that are all alike end after one round. In the first round, and in keys of no more than
    32 texts, all that meet are paired; in others they meet in blocks, where texts that the links so
    far connect are not compared and no more links are made than connect the alike ones.
    Texts meet only if their lengths let them reach the similarity, which loses none that do: an
    alignment matches at most the shorter one's shingles. From the second round on, shingles that
    stand in no other text of the keys left do not count, as no alignment can match them; a text
    that has too many of them, such as a far copy in a large group of copies, meets nobody more.
    """
    entries = cut_lineage(sketches.select(F.explode("keys").alias("key"), "node", F.octet_length("seq").alias("length")).distinct(), "near-keys")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("length") / BLOCK_BYTES))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1")
    members = entries.join(shared, "key")
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = cut_lineage(members.join(degrees, "node").select("key", "n", "parts", "node", "degree", "length"), "near-members")
    sequences = cut_lineage(sketches.join(degrees.select("node"), "node", "left_semi").groupBy("node").agg(F.any_value("seq").alias("seq")), "near-sequences")
    firsts = members.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("first")).select("key", F.col("first.node").alias("first"))
    active, links, roots, top = members, None, sketches.select("node", F.col("node").alias("root")).limit(0), 1
    while active.limit(1).count():
        own = None
        if top > 1:
            left = members.join(active.select("key").distinct(), "key", "left_semi").select("node").distinct()
            own = cut_lineage(own_shingles(sequences.join(left, "node", "left_semi")), "near-own")
            active = cut_lineage(reachable(active, own, similarity), "near-able")
        else:
            active = reachable(active, None, similarity)
        # only the leading rows of a key leave its tasks, so a large key is not ordered in one place
        ranked = members.join(active.select("key").distinct(), "key", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), F.desc("node")))).where(F.col("rank") <= top)
        live = active.select("key", "node", F.lit(True).alias("live"))
        ranked = cut_lineage(ranked.select("key", "node", "rank", "length").join(live, ["key", "node"], "left"), "near-leading")
        hubs = reachable(ranked.where(F.col("rank") > top // GROWTH), own, similarity).select("key", F.col("node").alias("hub"), F.col("rank").alias("hub_rank"), F.col("length").alias("hub_length"), F.col("shared").alias("hub_shared"), F.col("live").alias("hub_live"))
        texts = active.join(ranked.select("key", "node", "rank"), ["key", "node"], "left")
        # a live hub that ranks below the text meets it from its own side or has met it before
        met = (texts if top == 1 else texts.where(F.col("n") <= LARGE)).join(hubs, "key")
        met = met.where(F.col("rank").isNull() | (F.col("rank") > F.col("hub_rank")) | (F.col("rank") < F.col("hub_rank")) & F.col("hub_live").isNull())
        most = F.least("shared", "hub_shared")
        met = met.where(most >= (similarity - 1e-9) * (F.col("length") + F.col("hub_length") - most))
        pairs = met.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()
        held = sequences
        if top > 1:
            meeting = texts.select("node").union(hubs.select("hub")).distinct()
            held = cut_lineage(sequences.join(meeting, "node", "left_semi"), "near-held")
        alike = verified(pairs, held, similarity).where("alike").select("node", "hub")
        if top > 1:
            known = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            side = ("key", "parts", "node", "rank", "live", "root", "seq")
            large = texts.where(F.col("n") > LARGE).withColumn("live", F.lit(True))
            heads = hubs.withColumnsRenamed({"hub": "node", "hub_rank": "rank", "hub_live": "live"}).join(large.select("key", "parts").distinct(), "key")
            links_made = block_links(large.join(known, "node").select(*side), heads.join(known, "node").select(*side), similarity)
            alike = alike.unionByName(links_made)
        alike = cut_lineage(alike.distinct(), "near-alike")
        if alike.limit(1).count():
            links = alike if links is None else links.unionByName(alike)
            roots = components(links, "node", "hub")
        at, first_at = roots, roots.withColumnsRenamed({"node": "first", "root": "first_root"})
        rest = active.where(F.col("n") > top).join(firsts, "key").join(at, "node", "left").join(first_at, "first", "left")
        active = cut_lineage(rest.where(F.coalesce("root", "node") != F.coalesce("first_root", "first")).select("key", "n", "parts", "node", "degree", "length"), "near-active")
        top *= GROWTH
    return roots


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, keep_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(staged rows, row classes): every row of `docs`, numbered, and its class of near-duplicates.

    Staged rows have the columns of `docs` as c0, c1, ..., the text only if `keep_text`, and `_rid`; row classes have _rid, the
    key column, class_id (the least key of the class), class_rows and first, true for one row of
    each class: the one with the least (key, _rid).

    Two texts are near-duplicates if an alignment of their shingles of five lower-cased words
    matches 0.8 or more of them (matches against all distinct places of both); classes are linked
    groups. Equal texts are always together, null being the empty text. Texts of fewer than five
    words match only texts of the same words. Null keys come first; an empty table gives none.
    """
    base = numbered(docs)
    at, key_at = place(docs, text), place(docs, key)
    node = F.md5(F.coalesce(F.col(at), F.lit("")))
    staged = sketched(base.withColumn("_rid", F.monotonically_increasing_id()).withColumn("node", node), at)
    staged = cut_lineage(staged if keep_text else staged.drop(at), "near-sketches")
    roots = text_classes(staged.select("node", "keys", "seq"), similarity)
    rows = staged.select("_rid", F.col(key_at).alias("key"), "node").join(roots, "node", "left").select("_rid", "key", F.coalesce("root", "node").alias("root"))
    rows = cut_lineage(rows, "near-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key", "_rid")).alias("best"), F.count("*").alias("class_rows"))
    joined = rows.join(best, "root").select("_rid", F.col("key").alias(key), F.col("best.key").alias("class_id"), "class_rows", (F.col("_rid") == F.col("best._rid")).alias("first"))
    return staged, joined


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, one of each class of near-duplicates."""
    staged, joined = classes(docs, **options)
    kept = joined.where("first").select("_rid")
    return staged.join(kept, "_rid", "left_semi").select(*named_back(docs))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: its class, the class' rows and whether it is the one that stays."""
    _, joined = classes(docs.select("doc_id", "text"), keep_text=False)
    return joined.select("doc_id", "class_id", "class_rows", F.col("first").alias("kept"))
