"""Edges walked through a lattice: the cells they cross, what they cover there, and unions of areas.

Lengths are in cells, u to the east and v to the south. An edge is cut at the lattice lines it
crosses, nothing else is listed. A piece adds its height to the cover of every cell east of it in
its row, and the part of its own cell east of it to that cell's area; running sums along a row
then give the area of each crossed cell and the spans between them, as a scan-line fill does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.session import cut_lineage

#: Cells smaller shares of which count as not covered.
TOLERANCE = 1e-9
#: Pieces of a cell that one sweep takes; a cell with more is cut into SPLIT x SPLIT smaller ones.
SWEEP = 96
SPLIT = 4
#: Times a cell is cut at most: edges that meet in one point are never told apart by cutting.
DEPTH = 8

#: Rows of an area that one task takes; the edges of a larger one are dealt by bands of rows.
BAND = 64

PIECE = ("a_u", "a_v", "b_u", "b_v")


def _between(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def walked(
    edges: DataFrame, keys: Sequence[str], n_cols: int | None, n_rows: int | None, slack: float = 0.0
) -> DataFrame:
    """The pieces (a_u, a_v) to (b_u, b_v) of edges u1, v1, u2, v2 with row, col, weight and cross.

    `cross` is 1 or -1 where the edge goes south or north over its row's northern line. With a
    number of columns, all that lies west of the lattice is one piece in column -1. A slack
    assigns edges that come as near as that to a neighbouring cell as well. The edges are dealt by
    the keys and `band`, a run of rows, so that sums over rows of the keys need no further shuffle.
    """
    u1, v1, u2, v2 = (F.col(c) for c in ("u1", "v1", "u2", "v2"))
    north, south = F.floor(F.least(v1, v2) - slack), F.ceil(F.greatest(v1, v2) + slack) - 1
    south = F.greatest(north, south)
    if n_rows is not None:
        north, south = F.greatest(north, F.lit(0)), F.least(south, F.lit(n_rows - 1))
    # a level edge on a lattice line covers nothing, and what it closes is counted by the line
    listed = edges.where((v1 != v2) | (v1 != F.floor(v1)) | F.lit(slack > 0))
    ends = [F.col(c) for c in ("u1", "v1", "u2", "v2", "weight")]
    listed = listed.select(*keys, *ends, north.alias("_n"), south.alias("_s")).where("_n <= _s")
    banded = listed.withColumn("band", F.explode(F.sequence(F.floor(F.col("_n") / BAND), F.floor(F.col("_s") / BAND))))
    # a stated number of partitions: adaptive execution would merge them by their present size
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = banded.repartition(tasks, *keys, "band")
    first, last = F.greatest("_n", F.col("band") * BAND), F.least("_s", F.col("band") * BAND + BAND - 1)
    rows = dealt.withColumn("row", F.explode(F.sequence(first, last)))
    row = F.col("row").cast("double")

    def cut(u: Column, v: Column, at: Column) -> Column:
        """The edge's u at the height `at`, which is v where the edge ends there."""
        return F.when((at == v) | (v1 == v2), u).otherwise(u1 + (at - v1) * (u2 - u1) / (v2 - v1))

    rows = rows.withColumns({"_va": _between(v1, row, row + 1), "_vb": _between(v2, row, row + 1)})
    rows = rows.withColumns(
        {"_ua": cut(u1, v1, F.col("_va")), "_ub": cut(u2, v2, F.col("_vb"))}
    )
    ua, va, ub, vb = (F.col(c) for c in ("_ua", "_va", "_ub", "_vb"))
    west, east = F.floor(F.least(ua, ub) - slack), F.ceil(F.greatest(ua, ub) + slack) - 1
    east = F.greatest(west, east)
    # the line is crossed at u; where that is a corner, the way the edge goes south from it decides
    at_line = F.when((v1 <= row) & (v2 > row), ua).when((v2 <= row) & (v1 > row), ub)
    leaves_west = F.when(v2 > v1, u2 < u1).otherwise(u1 < u2)
    over = F.floor(at_line) - F.when((at_line == F.floor(at_line)) & leaves_west, 1).otherwise(0)
    if n_cols is not None:
        west, east = F.greatest(west, F.lit(-1)), F.least(F.greatest(east, F.lit(-1)), F.lit(n_cols - 1))
        # greatest() skips nulls, and an edge that crosses no line must not cross it here
        over = F.when(over.isNotNull(), F.greatest(over, F.lit(-1)))
    rows = rows.withColumns({"_w": west, "_e": east, "_over": over}).where("_w <= _e")
    cells = rows.withColumn("col", F.explode(F.sequence("_w", "_e")))
    col = F.col("col").cast("double")
    low = col if n_cols is None else F.when(F.col("col") < 0, F.lit(float("-inf"))).otherwise(col)
    cells = cells.withColumns(
        {"a_u": _between(ua, low, col + 1), "b_u": _between(ub, low, col + 1)}
    )

    def height(own: Column, end: Column, at_end: Column) -> Column:
        return F.when((own == end) | (ua == ub), at_end).otherwise(va + (own - ua) * (vb - va) / (ub - ua))

    cells = cells.withColumns(
        {"a_v": height(F.col("a_u"), ua, va), "b_v": height(F.col("b_u"), ub, vb)}
    )
    sign = F.when(v2 > v1, 1).otherwise(-1)
    cross = F.when(F.col("col") == F.col("_over"), sign).otherwise(0)
    return cells.select(*keys, "band", "row", "col", *PIECE, "weight", cross.alias("cross"))


def filled(pieces: DataFrame, keys: Sequence[str], n_cols: int | None) -> DataFrame:
    """(keys, row, col, share, crossed, corner): the signed share of each cell an area covers.

    Crossed cells stand here even when nothing of them is covered, with the winding number at
    their north-west corner; between them, and east of the last within the lattice, come the cells
    that no edge crosses, whose share is their winding number. Signs tell the orientation. The
    pieces of a band meet in one task, and a row has one crossed cell a column at most once they
    are added up, so running sums along it are short.
    """
    place = [*keys, "band", "row"]
    height = F.col("b_v") - F.col("a_v")
    own = height * (F.col("col") + 1 - (F.col("a_u") + F.col("b_u")) / 2.0)
    cells = pieces.groupBy(*place, "col").agg(
        F.sum(F.col("weight") * height).alias("_cover"),
        F.sum(F.col("weight") * own).alias("_own"),
        F.sum(F.col("weight") * F.col("cross")).alias("_cross"),
    )
    along = Window.partitionBy(*place).orderBy("col")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumns(
        {
            "_left": F.coalesce(F.sum("_cover").over(before), F.lit(0.0)),
            "_corner": F.coalesce(F.sum("_cross").over(before), F.lit(0)),
            "_next": F.lead("col").over(along),
        }
    )
    end = F.lit(None) if n_cols is None else F.lit(n_cols)
    after = F.col("_left") + F.col("_cover")
    last = F.when(F.abs(after) > TOLERANCE, F.coalesce(F.col("_next"), end) - 1)
    # the crossed cell and the span after it are one list, so the sums are made once
    listed = run.withColumn("_at", F.explode(F.sequence("col", F.greatest("col", last))))
    crossed = F.col("_at") == F.col("col")
    cells = listed.select(
        *keys,
        "row",
        F.col("_at").alias("col"),
        F.when(crossed, F.col("_left") + F.col("_own")).otherwise(after).alias("share"),
        crossed.alias("crossed"),
        F.when(crossed, F.col("_corner")).otherwise(0).cast("long").alias("corner"),
    )
    return cells if n_cols is None else cells.where("col >= 0")


def swept_area(pieces: np.ndarray, owner: np.ndarray, corner: np.ndarray) -> float:
    """Share of the unit cell that at least one owner covers, by a sweep from north to south.

    `pieces` are rows a_u, a_v, b_u, b_v, weight within the cell, `owner` says whose they are, and
    `corner` holds each owner's winding number at the north-west corner. That number goes on down
    the western side and changes where pieces come in or go out, so the side is an edge of that
    weight, and from each such place on one of the change. Between two neighbouring heights of ends
    and intersections no two edges cross, so their order at half height tells what is covered.
    """
    a_u, a_v, b_u, b_v, weight = pieces.T
    comes, goes = (a_u == 0) & (a_v > 0) & (a_v < 1), (b_u == 0) & (b_v > 0) & (b_v < 1)
    sides = [(0.0, corner, np.arange(len(corner))), (a_v[comes], -weight[comes], owner[comes]), (b_v[goes], weight[goes], owner[goes])]
    for start, change, whose in sides:
        n = len(whose)
        a_u, b_u = np.append(a_u, np.zeros(n)), np.append(b_u, np.zeros(n))
        a_v, b_v = np.append(a_v, np.broadcast_to(start, n)), np.append(b_v, np.ones(n))
        weight, owner = np.append(weight, change), np.append(owner, whose)
    steep = (a_v != b_v) & (weight != 0)
    a_u, a_v, b_u, b_v, weight, owner = (x[steep] for x in (a_u, a_v, b_u, b_v, weight, owner))
    if not len(a_u):
        return 0.0
    down = b_v > a_v
    top, low = np.minimum(a_v, b_v), np.maximum(a_v, b_v)
    sign = np.where(down, weight, -weight)
    slope = (b_u - a_u) / (b_v - a_v)
    base = np.where(down, a_u, b_u)
    # where two edges are at the same u, if both reach that height
    turn = slope[:, None] - slope[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        meet = ((base - slope * top)[None, :] - (base - slope * top)[:, None]) / turn
    both = (meet > np.maximum(top[:, None], top[None, :])) & (meet < np.minimum(low[:, None], low[None, :]))
    heights = np.unique(np.concatenate([top, low, meet[np.triu(both, 1)]]))
    total = 0.0
    for north, south in zip(heights[:-1], heights[1:], strict=True):
        mid = (north + south) / 2
        here = np.flatnonzero((top <= mid) & (low > mid))
        u = base[here] + slope[here] * (mid - top[here])
        order = np.argsort(u, kind="stable")
        wind, inside, since = np.zeros(len(corner)), 0, 0.0
        for k in order:
            who = owner[here[k]]
            was = wind[who] != 0
            wind[who] += sign[here[k]]
            now = wind[who] != 0
            if now and not was:
                inside += 1
                since = u[k] if inside == 1 else since
            elif was and not now:
                inside -= 1
                total += (u[k] - since) * (south - north) if inside == 0 else 0.0
        if inside:
            total += (1.0 - since) * (south - north)
    return float(total)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One area for each row of pieces, owners and corners."""
    for batch in batches:
        areas = []
        for pieces, owners in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            number = {o["geom"]: k for k, o in enumerate(owners)}
            rows = np.array([[p[c] for c in (*PIECE, "weight")] for p in pieces])
            areas.append(swept_area(rows, np.array([number[p["geom"]] for p in pieces]), np.array([o["corner"] for o in owners], float)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(areas, pa.float64())], names=["cell", "share"])


def union_shares(edges: DataFrame, n_cols: int, n_rows: int, sweep: int = SWEEP, depth: int = DEPTH) -> DataFrame:
    """(cell, share): how much of each cell the areas cover together, overlaps counting once.

    `edges` are geom, u1, v1, u2, v2 and weight; a cell is row * n_cols + col. Rings of one area do
    not overlap each other but for holes, whose edges run the other way. Cells that one area covers
    whole, or that one area alone meets, need no overlay; in the others a sweep over the pieces
    decides. A cell with more pieces than a sweep takes is cut into smaller ones, for which its
    pieces and its western side are the edges, and so on; what edges that meet in one point leave
    after `depth` cuts is swept whatever its size.
    """
    at = edges.withColumns({"cell": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    place, keys = ["cell", "part", "row", "col"], ["cell", "part", "geom"]
    found = None
    for level in range(depth + 1):
        cols, rows = (SPLIT, SPLIT) if level else (n_cols, n_rows)
        pieces = cut_lineage(walked(at, keys, cols, rows), "overlay-pieces")
        cells = filled(pieces.repartition(*keys, "band"), keys, cols)
        own = cells.select(*keys, "row", "col", F.abs("share").alias("share"), "corner")
        own = cut_lineage(own, "overlay-cells")
        count = pieces.groupBy(*place).agg(F.count("*").alias("pieces"))
        met = own.where(F.col("share") > TOLERANCE).groupBy(*place).agg(F.max("share").alias("most"), F.count("*").alias("geoms"))
        state = cut_lineage(met.join(count, place, "left").na.fill(0, ["pieces"]), "overlay-state")
        simple = (F.col("most") >= 1 - TOLERANCE) | (F.col("geoms") == 1)
        limit = sweep if level < depth else 1 << 62
        done = state.where(simple).select(*place, F.least("most", F.lit(1.0)).alias("share"))
        small = state.where(~simple & (F.col("pieces") <= limit)).select(*place)
        local = [(F.col(c) - F.col("col" if c.endswith("u") else "row")).alias(c) for c in PIECE]
        mine = F.struct("geom", *local, F.col("weight").cast("double").alias("weight"))
        listed = pieces.join(small, place).groupBy(*place).agg(F.collect_list(mine).alias("pieces"))
        owner = F.struct("geom", F.col("corner").cast("double").alias("corner"))
        owners = own.join(small, place).groupBy(*place).agg(F.collect_list(owner).alias("owners"))
        both = listed.join(owners, place).select(F.struct(*place).alias("cell"), "pieces", "owners")
        swept = both.mapInArrow(_swept, f"cell {both.schema['cell'].dataType.simpleString()}, share double")
        shares = done.unionByName(swept.select("cell.*", "share"))
        # at first a cell is a place of the lattice, later a part of one
        cell = F.col("cell") if level else F.col("row") * n_cols + F.col("col")
        shares = cut_lineage(shares.select(cell.alias("cell"), (F.col("share") * float(SPLIT) ** (-2 * level)).alias("share")), "overlay-shares")
        found = shares if found is None else found.unionByName(shares)
        part = F.col("part") * SPLIT**2 + F.col("row") * SPLIT + F.col("col") if level else F.lit(0).cast("long")
        large = cut_lineage(state.where(~simple & (F.col("pieces") > limit)).select(*place, cell.alias("_cell"), part.alias("_part")), "overlay-large")
        if large.isEmpty():
            break
        at = _cut_cells(pieces, own, large, place)
    return found.groupBy("cell").agg(F.sum("share").alias("share"))


def _cut_cells(pieces: DataFrame, own: DataFrame, large: DataFrame, place: list[str]) -> DataFrame:
    """The edges of the large cells, their western sides among them, in smaller cells' lengths."""
    local = {c: F.col(c) - F.col("col" if c.endswith("u") else "row") for c in PIECE}
    inside = pieces.join(large, place).withColumns(local)
    head = [F.col("_cell").alias("cell"), F.col("_part").alias("part"), "geom"]

    def edge(weight: Column, *ends: Column) -> list[Column]:
        return [(x * SPLIT).alias(n) for x, n in zip(ends, ("u1", "v1", "u2", "v2"), strict=True)] + [weight.cast("long").alias("weight")]

    zero, one = F.lit(0.0), F.lit(1.0)
    a_u, a_v, b_u, b_v = (F.col(c) for c in PIECE)
    comes = inside.where((a_u == 0) & (a_v > 0) & (a_v < 1)).select(*head, *edge(-F.col("weight"), zero, a_v, zero, one))
    goes = inside.where((b_u == 0) & (b_v > 0) & (b_v < 1)).select(*head, *edge(F.col("weight"), zero, b_v, zero, one))
    corners = own.join(large, place).where("corner != 0").select(*head, *edge(F.col("corner"), zero, zero, zero, one))
    return inside.select(*head, *edge(F.col("weight"), a_u, a_v, b_u, b_v)).unionByName(comes).unionByName(goes).unionByName(corners)
