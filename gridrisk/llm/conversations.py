"""Cheapest repair of the turns of a conversation, as a shortest path found by an auction.

A repaired conversation has the roles `(s?(ua)+)?` by their initials. Between two rows there are
four states (nothing yet, after a system row, after a user row, after an assistant row), so the
rows of a conversation span a lattice of four nodes a layer whose arcs keep, rerole or delete the
row, after insertions. An auction finds shortest paths: the path is extended over an arc whose
cost equals the difference of its nodes' prices, or the price of its last node is raised and the
path contracted. At the end exactly the arcs of cheapest repairs from the origin are tight, and
following the tight arc of least letters gives the least of them.

A conversation is cut into stretches of a few rows. The auction prices each stretch between any
two states; a stretch is then one layer of a lattice of stretches, and so on until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridrisk.llm.text import column
from gridrisk.session import cut_lineage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
STRETCH = 32  # layers of an auction
TOGETHER = 1 << 12  # stretches of a conversation that one task takes
REMEMBERED = 20_000  # stretches of rows whose prices a task keeps

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of a role, by state and role's initial.
AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a row whose role is chosen.
CHOSEN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What ends a conversation in a state, with its cost.
ENDS = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
ROLES = {USER: "user", ASSISTANT: "assistant"}

INITIALS = "sua"  # kinds 0 to 3 are these and any other, 4 to 7 the same truncated, 8 is a row that must go
GONE = 8
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 40  # the cost of an arc that does not exist


def arcs(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and letters of the cheapest, then least, edits of one row from state to state."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    initial = (*INITIALS, "")[kind % 4]
    for state in range(4):
        at = state
        for inserts in range(3):
            paid, letters = inserts * INSERT, "I" * inserts
            choices = [(at, paid + DELETE, letters + "D")]
            if kind != GONE:
                paid += TRUNCATED * (kind // 4)
                choices.append((CHOSEN[at], paid + REROLE, letters + "R"))
                if (at, initial) in AFTER:
                    choices.append((AFTER[at, initial], paid, letters + "K"))
            for end, cost, word in choices:
                out[state, end] = min(out.get((state, end), (FAR, "")), (cost, word))
            at = CHOSEN[at]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Costs and ranks of letters, [kind][state][state], and the letters in the same order."""
    cost, rank, letters = np.full((9, 4, 4), FAR, np.int64), np.zeros((9, 4, 4), np.int64), []
    for kind in range(9):
        found = arcs(kind)
        for a in range(4):
            words = sorted(found[a, b][1] for b in range(4) if (a, b) in found)
            for b in range(4):
                if (a, b) in found:
                    cost[kind, a, b] = found[a, b][0]
                    rank[kind, a, b] = words.index(found[a, b][1])
                letters.append(found.get((a, b), (FAR, ""))[1])
    return cost, rank, letters


COST, RANK, LETTERS = _tables()


def auction(cost: np.ndarray, rank: np.ndarray, layers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs [problem][from][to] and paths [problem][from][to][layer] through lattices of four states.

    `cost` and `rank` are [problem][layer][state][state]; `layers` says how many layers a problem
    has. One lane goes to each last state of each problem; the four first states take their turns
    as its origin and go on with the prices found. Prices stay feasible, so an arc once no longer
    tight stays so while its first node is on the path; the extension to the tight arc of least
    rank therefore traces the least of all shortest paths.
    """
    problems, most = cost.shape[:2]
    lanes = problems * 4
    own, last = np.repeat(np.arange(problems), 4), np.tile(np.arange(4), problems)
    size = layers[own]
    price = np.zeros((lanes, most + 1, 4), np.int64)
    price[np.arange(lanes), size] = FAR
    price[np.arange(lanes), size, last] = 0
    total, paths = np.full((lanes, 4), FAR, np.int64), np.zeros((lanes, 4, most + 1), np.int8)
    for origin in range(4):
        path = np.zeros((lanes, most + 1), np.int8)
        path[:, 0] = origin
        depth = np.zeros(lanes, np.int64)
        lane = np.flatnonzero(size > 0)
        while len(lane):
            at = depth[lane]
            state = path[lane, at]
            through = np.minimum(cost[own[lane], at, state] + price[lane, at + 1], FAR)
            least = through.min(axis=1)
            raised = price[lane, at, state] < least
            # contract: the price rises to the cheapest way on, and the path loses its last node
            up = lane[raised]
            price[up, at[raised], state[raised]] = least[raised]
            depth[up] = np.maximum(at[raised] - 1, 0)
            # extend, unless there is no way at all
            on = ~raised & (least < FAR)
            ahead = np.where(through[on] == least[on, None], rank[own[lane[on]], at[on], state[on]], 127).argmin(axis=1)
            further = lane[on]
            path[further, at[on] + 1] = ahead
            depth[further] = at[on] + 1
            lane = lane[raised | (on & (at + 1 < size[lane]))]
        total[:, origin] = price[:, 0, origin]
        paths[:, origin] = path
    return total.reshape(problems, 4, 4).transpose(0, 2, 1), paths.reshape(problems, 4, 4, most + 1).transpose(0, 2, 1, 3)


def priced(costs: list[np.ndarray], ranks: list[np.ndarray], at_once: int = 1024) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For each stretch, given as [layer][state][state]: costs, ranks of the ways, and their states as digits."""
    out: list = [None] * len(costs)
    order = sorted(range(len(costs)), key=lambda k: len(costs[k]))
    for first in range(0, len(order), at_once):
        some = order[first : first + at_once]
        sizes = np.array([len(costs[k]) for k in some])
        most = int(sizes.max())
        cost, rank = np.full((len(some), most, 4, 4), FAR, np.int64), np.zeros((len(some), most, 4, 4), np.int64)
        for j, k in enumerate(some):
            cost[j, : sizes[j]], rank[j, : sizes[j]] = costs[k], ranks[k]
        total, paths = auction(cost, rank, sizes)
        for j, k in enumerate(some):
            n, ways, place = int(sizes[j]), [], np.zeros((4, 4), np.int64)
            for a in range(4):
                words = []
                for b in range(4):
                    p = paths[j, a, b, : n + 1]
                    ways.append((p + 48).astype(np.uint8).tobytes().decode())
                    # ways of one first state differ first where their letters do
                    words.append(rank[j, np.arange(n), p[:-1], p[1:]].astype(np.uint8).tobytes() if total[j, a, b] < FAR else b"\xff")
                place[a] = [sorted(set(words)).index(w) for w in words]
            out[k] = (total[j], place, ways)
    return out


PRICES = "cost array<bigint>, rank array<bigint>, ways array<string>"


def _stretches(batches: Iterator[pa.RecordBatch], lists: list[str], solve: Callable) -> Iterator[pa.RecordBatch]:
    """Runs of at most STRETCH neighbouring rows of a conversation as one row with lists of the columns."""
    task, made, held = TaskContext.get().partitionId() << 36, 0, None

    def closed(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        offsets = pa.array(bounds.astype(np.int32))
        own = [pa.ListArray.from_arrays(offsets, column(rows, n).slice(0, int(bounds[-1]))) for n in lists]
        ids = pa.array(task + made + np.arange(len(bounds) - 1))
        made += len(ids)
        found = solve(rows, bounds)
        prices = [pa.array([f[k].ravel().tolist() for f in found], pa.list_(pa.int64())) for k in (0, 1)] + [pa.array([f[2] for f in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([column(rows, "conv").take(pa.array(bounds[:-1])), ids, *own, *prices], names=["conv", "id", *lists, "cost", "rank", "ways"])

    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(rows):
            continue
        codes = pc.dictionary_encode(column(rows, "conv"), null_encoding="encode").indices.to_numpy()
        first = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
        within = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        starts = np.flatnonzero(within % STRETCH == 0)
        if len(starts) > 1:
            yield closed(rows, starts)
        held = rows.slice(int(starts[-1]))
    if held is not None and len(held):
        yield closed(held, np.array([0, len(held)]))


_prices: dict[bytes, tuple[np.ndarray, np.ndarray, list[str]]] = {}


def _price_rows(rows: pa.RecordBatch, bounds: np.ndarray) -> list:
    kinds = column(rows, "kind").to_numpy().astype(np.uint8).tobytes()
    copies = np.concatenate([[0], np.cumsum(column(rows, "copies").to_numpy() - 1)])
    keys = [kinds[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    new = [k for k in dict.fromkeys(keys) if k not in _prices]
    if len(_prices) + len(new) > REMEMBERED:
        _prices.clear()
        new = list(dict.fromkeys(keys))
    layers = [np.frombuffer(k, np.uint8) for k in new]
    _prices.update(zip(new, priced([COST[k] for k in layers], [RANK[k] for k in layers]), strict=True))
    out = []
    for k, a, b in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        total, rank, ways = _prices[k]
        # further copies of a row go, whatever the states
        out.append((np.where(total < FAR, total + DELETE * (copies[b] - copies[a]), FAR), rank, ways))
    return out


def _price_stretches(rows: pa.RecordBatch, bounds: np.ndarray) -> list:
    cost, rank = (column(rows, n).flatten().to_numpy().reshape(-1, 4, 4) for n in ("cost", "rank"))
    cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return priced([cost[a:b] for a, b in cuts], [rank[a:b] for a, b in cuts])


KEYS = ["conv", "turn", "role", "digest"]


def prepared(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and the text's digest, a null role or text being one blank."""
    picked = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    return picked.withColumn("digest", F.unhex(F.md5("text")))


def faults(rows: DataFrame) -> DataFrame:
    """The different rows of each conversation with copies, kind, and whether blank, repeated and truncated.

    Only the first of equal role and text in a conversation is not a repetition, and of a row with
    copies only the first copy. Rows are told apart by conversation, turn, role and a 128-bit digest.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    marks = [(F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut")]
    rows = rows.select(*KEYS, *marks)
    kinds = rows.groupBy(*KEYS).agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    firsts = kinds.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).getField("turn").alias("turn"))
    # the first of its role and text is marked by meeting itself again, nulls included
    none = [F.lit(None).cast(t).alias(n) for n, t in (("copies", "long"), ("blank", "boolean"), ("cut", "boolean"))]
    both = kinds.select(*KEYS, "copies", "blank", "cut", F.lit(0).alias("first")).unionByName(firsts.select(*KEYS, *none, F.lit(1).alias("first")))
    met = both.groupBy(*KEYS).agg(F.max("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))
    role: Column = F.lit(3)
    for k, letter in enumerate(INITIALS):
        role = F.when(initial == letter, F.lit(k)).otherwise(role)
    gone = F.col("blank") | (F.col("first") == 0)
    return met.select(*KEYS, "copies", "blank", (~F.col("blank") & (F.col("first") == 0)).alias("repeated"), (~gone & F.col("cut")).alias("cut"), F.when(gone, F.lit(GONE)).otherwise(role + 4 * F.col("cut").cast("int")).cast("int").alias("kind"))


def repair_plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of the rows that `prepared` gives, and each conversation's cost and last state.

    Edits carry the row's keys, copies, faults and kind, `part` and `place` that order the rows of
    a conversation, the states before and after, and `letters`. Rows of equal turn are ordered by
    role and digest, nulls first. No task holds more than a batch of rows or stretches at once.
    """
    found = cut_lineage(faults(rows), "conversation-faults")
    kept = {n: found.schema[n].dataType.simpleString() for n in (*KEYS[1:], "copies", "blank", "repeated", "cut", "kind")}
    head = f"conv {found.schema['conv'].dataType.simpleString()}, id bigint"

    def stretched(items: DataFrame, dealt: list[str], order: list[str], lists: dict[str, str], solve: Callable) -> DataFrame:
        sorted_ = items.repartitionByRange(*dealt).sortWithinPartitions(*order).select("conv", *lists)
        # prices of the children are read and not handed on
        own = {n: t for n, t in lists.items() if n not in ("cost", "rank")}
        schema = ", ".join([head, *(f"{n} array<{t}>" for n, t in own.items()), PRICES])
        return cut_lineage(sorted_.mapInArrow(lambda batches: _stretches(batches, list(own), solve), schema), "conversation-stretches")

    levels = [stretched(found, KEYS, KEYS, kept, _price_rows)]
    whole: list[DataFrame] = []  # conversations of one stretch, by level
    while True:
        items = levels[-1].select("conv", "id", "cost", "rank")
        many = cut_lineage(items.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("_conv"), F.col("n").alias("_n")), "conversation-long")
        same = F.col("conv").eqNullSafe(F.col("_conv"))
        whole.append(items.join(many, same, "left_anti"))
        if many.isEmpty():
            break
        # a conversation of no more than TOGETHER stretches stays in one task, so that none is cut again
        parts = items.join(many, same).withColumnRenamed("id", "child").withColumn("_deal", F.when(F.col("_n") > TOGETHER, F.col("child")).otherwise(F.lit(0)))
        higher = stretched(parts, ["conv", "_deal"], ["conv", "child"], {"child": "bigint", "cost": "array<bigint>", "rank": "array<bigint>"}, _price_stretches)
        # numbers of stretches differ between levels
        levels.append(higher.withColumn("id", F.col("id") + F.lit(len(levels) << 56)))
    ends = [F.struct((F.col("cost")[k] + cost).alias("cost"), F.col("rank")[k].alias("rank"), F.lit(k).alias("last")) for k, (cost, _) in ENDS.items()]
    tops = [w.select("conv", "id", F.least(*ends).alias("end")).select("conv", "id", "end.cost", "end.last") for w in whole]
    states = None
    for level, top in zip(reversed(levels), reversed(tops), strict=True):
        own = top.select("id", F.lit(NONE).alias("before"), F.col("last").alias("after"))
        states = own if states is None else cut_lineage(own.unionByName(states), "conversation-states")
        chosen = level.join(states, "id").withColumn("_way", F.element_at("ways", F.col("before") * 4 + F.col("after") + 1)).drop("before", "after", "cost", "rank", "ways")
        if level is not levels[0]:
            states = chosen.select("_way", F.posexplode("child").alias("place", "id")).select("id", *_ends_of_row())
    each = chosen.select("conv", F.col("id").alias("part"), "_way", F.posexplode(F.arrays_zip(*kept)).alias("place", "_row"))
    edits = each.select("conv", "part", "place", "_row.*", *_ends_of_row())
    word = F.element_at(F.array(*[F.lit(x) for x in LETTERS]), F.col("kind") * 16 + F.col("before") * 4 + F.col("after") + 1)
    letters = F.concat(word, F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int")))
    costs = tops[0]
    for top in tops[1:]:
        costs = costs.unionByName(top)
    return edits.withColumn("letters", letters), costs.drop("id")


def _ends_of_row() -> list[Column]:
    return [F.substring(F.col("_way"), F.col("place") + k, F.lit(1)).cast("int").alias(n) for k, n in ((1, "before"), (2, "after"))]


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of the cheapest repair: conv, turn, role, text, edit, and part, place, step that order them.

    A conversation's rows are those of its id, a null id being one as well. They stand in the
    order of turn, nulls first, then role and a digest of the text; a null role or text is one
    blank. `edit` is K, R or I; inserted rows have no turn and an empty text. Conversations that
    are best deleted, and empty tables, give no rows; further columns are not read.
    """
    rows_ = cut_lineage(prepared(rows, conv, turn, role, text), "conversation-texts")
    edits, costs = repair_plan(rows_)
    edits = cut_lineage(edits, "conversation-edits")
    stays = F.regexp_extract("letters", "^I*([KR]?)", 1)
    texts = rows_.groupBy(*KEYS).agg(F.first("text").alias("text"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
    kept = edits.withColumn("edit", stays).where("edit != ''").alias("a").join(texts.alias("b"), same).select("a.conv", "a.turn", F.when(F.col("edit") == "K", F.col("a.role")).when(F.col("after") == USER, F.lit(ROLES[USER])).otherwise(F.lit(ROLES[ASSISTANT])).alias("role"), "text", "edit", "part", "place", F.lit(9).alias("step"))
    inserts = F.length(F.regexp_extract("letters", "^I*", 0))
    # an insertion after a user row is an assistant's, any other a user's, and so in turns
    spoken = lambda before, step: F.when((F.when(before == USER, F.lit(1)).otherwise(F.lit(0)) + step) % 2 == 1, F.lit(ROLES[ASSISTANT])).otherwise(F.lit(ROLES[USER]))
    new = lambda state: [F.lit(None).cast(rows_.schema["turn"].dataType).alias("turn"), spoken(state, F.col("step")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")]
    within = edits.where(inserts > 0).withColumn("step", F.explode(F.sequence(F.lit(0), inserts - 1)))
    made = within.select("conv", *new(F.col("before")), "part", "place", "step")
    last = costs.where(F.col("last").isin(SYSTEM, USER)).withColumn("step", F.explode(F.sequence(F.lit(0), F.when(F.col("last") == SYSTEM, F.lit(1)).otherwise(F.lit(0)))))
    ended = last.select("conv", *new(F.col("last")), F.lit((1 << 63) - 1).alias("part"), F.lit(0).alias("place"), "step")
    return kept.unionByName(made).unionByName(ended).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `conversations` with damage dealt by the checksum of conversation and turn, and those dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    dealt = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_lot"))
    left = dealt.where("_lot != 0")
    text = F.when(F.col("_lot") == 1, F.lit("")).when(F.col("_lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("_lot") == 3, F.lit(2)).otherwise(F.lit(1))))
    return left.select("conv_id", "turn", F.when(F.col("_lot") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy"), dealt.where("_lot = 0").select("conv_id")


LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digest(convs: DataFrame) -> DataFrame:
    """What the repair of every damaged conversation comes to, one row a conversation.

    The audit and the checksum run over a whole conversation, so the last pass streams it through
    one task, a batch at a time; of a conversation only the audit is held.
    """
    rows, dropped = damaged(convs)
    rows = prepared(rows)
    edits, costs = repair_plan(rows)
    kind = rows.schema["conv"].dataType.simpleString()
    sides = {
        "turn": rows.schema["turn"].dataType.simpleString(), "role": "string", "digest": "binary", "text": "string", "copies": "bigint",
        "blank": "boolean", "repeated": "boolean", "cut": "boolean", "before": "int", "after": "int", "letters": "string", "cost": "bigint",
    }

    def side(df: DataFrame, order: int) -> DataFrame:
        return df.select("conv", *[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in sides.items()], F.lit(order > 2).alias("_end"), F.lit(order).alias("_side"))

    both = side(edits, 0).unionByName(side(rows, 1)).unionByName(side(dropped.distinct().withColumnRenamed("conv_id", "conv"), 2)).unionByName(side(costs.withColumnRenamed("last", "after"), 3))
    order = ["_end", "turn", "role", "digest", "_side"]
    sorted_ = both.repartition("conv").sortWithinPartitions("conv", *order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        own, now = None, None
        for batch in batches:
            names = ("conv", *sides, "_side")
            for conv, turn, role, _, text, copies, blank, repeated, cut, before, after, letters, cost, which in zip(*[column(batch, n).to_pylist() for n in names], strict=True):
                if now is None or conv != own:
                    if now is not None:
                        done.append((own, *now.row()))
                    own, now = conv, _Digest()
                if which == 0:
                    now.edit(turn, role, copies, blank, repeated, cut, before, after, letters)
                elif which == 1:
                    now.text(text)
                elif which == 3:
                    now.end(after, cost)
            if len(done) > 1000:
                yield table(done)
                done = []
        if now is not None:
            done.append((own, *now.row()))
        if done:
            yield table(done)

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_pydict(dict(zip(("conv_id", *LONGS, "audit", "repaired_sha256"), columns, strict=True)), schema=arrow)

    arrow = pa.schema([("conv_id", to_arrow_type(rows.schema["conv"].dataType)), *((n, pa.int64()) for n in LONGS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return sorted_.mapInArrow(read, f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in LONGS) + ", audit string, repaired_sha256 string")


class _Digest:
    """Running counts, audit and checksum of one conversation."""

    def __init__(self):
        self.blank = self.repeated = self.cut = self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.previous = self.waiting = None
        self.letters: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
        self.begun = True

    def _inserted(self, state: int, count: int) -> None:
        for _ in range(count):
            state = CHOSEN[state]
            self._write(ROLES[state], "")

    def edit(self, turn, role, copies, blank, repeated, cut, before, after, letters) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.blank += copies * blank
        self.repeated += 0 if blank else copies - (not repeated)
        self.cut += cut
        initial = role[:1]
        self.illegal += (self.previous is not None and self.previous + initial not in ("su", "ua", "au")) + copies - 1
        self.previous = initial
        self.letters.append(letters)
        own = letters.lstrip("I")
        self._inserted(before, len(letters) - len(own))
        self.waiting = {"K": role, "R": ROLES.get(after), "D": None}[own[0]]

    def text(self, text: str) -> None:
        if self.waiting is not None:
            self._write(self.waiting, text)
            self.waiting = None

    def end(self, last: int, cost: int) -> None:
        self.cost = cost
        self.letters.append(ENDS[last][1])
        self._inserted(last, len(ENDS[last][1]))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.repeated, self.cut, self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest()
