"""Polygons, lines and points against the grid, by explicit buckets.

Spark has no spatial index, so every predicate here is an equi-join on a square bucket followed by
the exact test. Buckets only ever propose candidates; none of them is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.functions import geometry as geo
from gridrisk.operators import overlay
from gridrisk.operators.grid import GridSpec
from gridrisk.session import cut_lineage

#: Columns of a row of cells that are one number while cells are merged.
BLOCK_COLS = 64
#: Cells that a task measures at once.
CANDIDATES = 1 << 18


def cell_edges(polygons: DataFrame, spec: GridSpec, sides: str = "sides") -> DataFrame:
    """(geom_id, x1 ... y2, u1 ... v2, weight): edges one by one, their ends also in cells east and south."""
    lined = polygons.select("geom_id", F.inline(sides))
    size, left, top = F.lit(float(spec.resolution)), F.lit(float(spec.xmin)), F.lit(float(spec.ymax))
    east = {f"u{k}": (F.col(f"x{k}") - left) / size for k in (1, 2)}
    south = {f"v{k}": (top - F.col(f"y{k}")) / size for k in (1, 2)}
    return lined.withColumns({**east, **south, "weight": F.lit(1)})


def polygon_cells(
    polygons: DataFrame, spec: GridSpec, sides: str = "sides", tolerance: float = overlay.TOLERANCE
) -> DataFrame:
    """(geom_id, cell_id, area) of every cell whose interior a polygon overlaps.

    Touching an edge is not overlapping. Edges list the cells they cross, and each row of a polygon
    is filled between them, so the work grows with the outline and the rows returned.
    """
    found = _met_cells(polygons, spec, sides).where(F.abs("share") > tolerance)
    return found.select("geom_id", "cell_id", (F.abs("share") * float(spec.resolution) ** 2).alias("area"))


def _met_cells(polygons: DataFrame, spec: GridSpec, sides: str) -> DataFrame:
    pieces = overlay.walked(cell_edges(polygons, spec, sides), ["geom_id"], spec.n_cols, spec.n_rows)
    found = overlay.filled(pieces, ["geom_id"], spec.n_cols)
    return found.withColumn("cell_id", F.col("row").cast("bigint") * spec.n_cols + F.col("col"))


def _near_cells(edges: DataFrame, spec: GridSpec, radius: float) -> DataFrame:
    """(geom_id, row, block, mask, low, high): cells nearer than the radius to an edge, as bits of a block of columns.

    An edge proposes, row by row, the cells within the radius of the part of it that is within the
    radius of the row; `low` and `high` are the first and last column of the bits. A cell is near
    if an end of the edge is near its box, or a corner of the box that lies beside the edge, since
    elsewhere an end is as near; an edge that crosses the box without that is told by its crossing.
    """
    n_rows, n_cols, size = spec.n_rows, spec.n_cols, float(spec.resolution)
    left, top, reach, r = float(spec.xmin), float(spec.ymax), radius * (1 - 1e-12), radius / size

    def expanded(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, number from first to last there) in order, at most some CANDIDATES at once or one place's."""
        n = np.maximum(last - first + 1, 0)
        upto = np.cumsum(n)
        a = 0
        while a < len(n):
            done = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + CANDIDATES, "right")))
            place = np.repeat(np.arange(a, b), n[a:b])
            yield place, first[place] + np.arange(len(place)) - (upto[place] - n[place] - done)
            a = b

    def held(index: np.ndarray, last: int) -> np.ndarray:
        return np.clip(np.floor(index), -1, last + 1).astype(np.int64)

    def close(x1, y1, x2, y2, row, col) -> np.ndarray:
        """Whether each edge is near its box."""
        x0, y0 = left + col * size, top - (row + 1) * size
        near = np.zeros(len(row), bool)
        for px, py in ((x1, y1), (x2, y2)):
            dx = np.maximum(np.maximum(x0 - px, 0.0), px - (x0 + size))
            dy = np.maximum(np.maximum(y0 - py, 0.0), py - (y0 + size))
            near |= dx * dx + dy * dy < reach * reach
        ex, ey = x2 - x1, y2 - y1
        length = ex * ex + ey * ey
        for x in (x0, x0 + size):
            for y in (y0, y0 + size):
                along, across = (x - x1) * ex + (y - y1) * ey, (x - x1) * ey - (y - y1) * ex
                near |= (along > 0) & (along < length) & (across * across < reach * reach * length)
        return near

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2")
        for batch in batches:
            values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names])
            real = np.flatnonzero(np.isfinite(values).all(axis=0))
            values = values[:, real]
            v1, v2 = values[5], values[7]
            north = np.maximum(held(np.minimum(v1, v2) - r, n_rows - 1), 0)
            south = np.minimum(held(np.maximum(v1, v2) + r, n_rows - 1), n_rows - 1)
            for edge, row in expanded(north, south):
                u1, v1, u2, v2 = values[4:, edge]
                level = v1 == v2
                slope = (u2 - u1) / np.where(level, 1.0, v2 - v1)
                # where the edge is at the nearest height that the band and the edge share
                a, b = (np.where(level, u, u1 + (np.clip(v, row - r, row + 1 + r) - v1) * slope) for u, v in ((u1, v1), (u2, v2)))
                west = np.maximum(held(np.minimum(a, b) - r, n_cols - 1), 0)
                east = np.minimum(held(np.maximum(a, b) + r, n_cols - 1), n_cols - 1)
                for at, col in expanded(west, east):
                    hit = close(*values[:4, edge[at]], row[at], col)
                    at, col = at[hit], col[hit]
                    if not len(at):
                        continue
                    block = col // BLOCK_COLS
                    heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (block[1:] != block[:-1])))
                    bits = np.left_shift(np.uint64(1), (col % BLOCK_COLS).astype(np.uint64))
                    mask = np.bitwise_or.reduceat(bits, heads).view(np.int64)
                    high = col[np.append(heads[1:], len(col)) - 1]
                    geom = batch.column(batch.schema.get_field_index("geom_id")).take(pa.array(real[edge[at[heads]]]))
                    yield pa.RecordBatch.from_arrays([geom, *(pa.array(x) for x in (row[at[heads]], block[heads], mask, col[heads], high))], names=["geom_id", "row", "block", "mask", "low", "high"])

    kind = edges.schema["geom_id"].dataType.simpleString()
    return edges.select("geom_id", "x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2").mapInArrow(near, f"geom_id {kind}, row bigint, block bigint, mask bigint, low bigint, high bigint")


def buffered_cells(
    polygons: DataFrame, spec: GridSpec, radius: float, sides: str = "sides"
) -> DataFrame:
    """(geom_id, cell_id) of every cell the polygon grown by `radius` overlaps.

    The grown polygon is never built: a cell overlaps it when it overlaps the polygon or lies
    nearer than the radius to an edge. Cells of a row are bits of blocks of columns, which fall
    together before they are shuffled.
    """
    # an edge that enters a cell is no distance away, wherever its ends are
    met = _met_cells(polygons, spec, sides).where((F.abs("share") > overlay.TOLERANCE) | (F.col("crossed") & F.lit(radius > 0)))
    row, col = F.col("row").cast("bigint"), F.col("col").cast("bigint")
    block = F.floor(col / BLOCK_COLS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(col, F.lit(BLOCK_COLS)).cast("int"))
    met = met.select("geom_id", row.alias("row"), block.alias("block"), bit.alias("mask"), col.alias("low"), col.alias("high"))
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cell_edges(polygons, spec, sides).repartition(tasks, "geom_id", "x1", "y1")
    both = met.unionByName(_near_cells(dealt, spec, float(radius)))
    runs = both.groupBy("geom_id", "row", "block").agg(F.bit_or("mask").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"))
    listed = runs.withColumn("col", F.explode(F.sequence("low", "high")))
    held = listed.where(F.getbit("mask", (F.col("col") - F.col("block") * BLOCK_COLS).cast("int")) == 1)
    return held.select("geom_id", (F.col("row") * spec.n_cols + F.col("col")).alias("cell_id"))


def area_shares(
    polygons: DataFrame, spec: GridSpec, threshold: float, sides: str = "sides"
) -> DataFrame:
    """Share of each touched cell a layer covers, and whether it reaches the threshold.

    What several features cover counts once, as if the layer had been dissolved. Features that are
    equal edge by edge are taken once from the start.
    """
    same = polygons.groupBy(F.xxhash64(sides).alias("_hash"), F.col(sides).alias("sides")).agg(F.min("geom_id").alias("geom_id"))
    edges = cell_edges(same, spec).withColumnRenamed("geom_id", "geom").select("geom", "u1", "v1", "u2", "v2", "weight")
    shares = overlay.union_shares(edges, spec.n_cols, spec.n_rows)
    return shares.select(F.col("cell").cast("bigint").alias("cell_id"), F.col("share").alias("fraction")).withColumn(
        "is_covered", F.col("fraction") >= threshold
    )


def overlapping_cells(polygons: DataFrame, spec: GridSpec, sides: str = "sides", tolerance: float = 1e-9) -> DataFrame:
    """(cell_id, times): cells where the features of a layer add up to more than they cover together."""
    added = polygon_cells(polygons, spec, sides).groupBy("cell_id").agg((F.sum("area") / float(spec.resolution) ** 2).alias("_sum"))
    both = added.join(area_shares(polygons, spec, 0.0, sides), "cell_id")
    return both.where(F.col("_sum") > F.col("fraction") + tolerance).select("cell_id", (F.col("_sum") / F.col("fraction")).alias("times"))


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    bucket: float,
    x: str = "x",
    y: str = "y",
    sides: str = "sides",
) -> DataFrame:
    """Every point with each polygon that contains it.

    A polygon goes to the buckets that its edges cross, carrying to each only the edges of its row
    that a ray to the right of a point there can cross, and to those between them, where a point
    needs no test. What lies in the polygon's box and not in the polygon is never listed.
    """
    size = F.lit(float(bucket))
    lined = polygons.select("geom_id", F.inline(sides))
    ends = {f"{a}{k}": F.col(f"{c}{k}") / size for a, c in (("u", "x"), ("v", "y")) for k in (1, 2)}
    edges = lined.withColumns({**ends, "weight": F.lit(1)})
    # an edge near a bucket's border counts for both, so that rounding never decides
    pieces = overlay.walked(edges, ["geom_id"], None, None, slack=1e-9)
    cells = overlay.filled(pieces, ["geom_id"], None)
    odd = F.round(F.abs("share")) % 2 == 1
    north = F.floor(F.least("v1", "v2") - 1e-9)
    south = F.greatest(north, F.ceil(F.greatest("v1", "v2") + 1e-9) - 1)
    edge = F.struct("x1", "y1", "x2", "y2")
    by_row = edges.withColumn("row", F.explode(F.sequence(north, south))).groupBy("geom_id", "row").agg(F.collect_list(edge).alias("_row"))
    right = F.filter("_row", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("col") * size)
    spread = cells.where(F.col("crossed") | odd).join(by_row, ["geom_id", "row"]).select(
        "geom_id", "row", "col", (~F.col("crossed")).alias("_whole"), F.when(F.col("crossed"), right).alias("_sides")
    )
    spread = spread.select("geom_id", F.col("col").alias("_bx"), F.col("row").alias("_by"), "_whole", "_sides")
    placed = points.withColumns(
        {"_bx": F.floor(F.col(x) / size), "_by": F.floor(F.col(y) / size)}
    )
    return (
        placed.join(spread, ["_bx", "_by"])
        .where(F.col("_whole") | geo.contains(F.col("_sides"), F.col(x), F.col(y)))
        .drop("_bx", "_by", "_whole", "_sides")
    )


def ignition_points(polygons: DataFrame, sides: str = "sides") -> DataFrame:
    """One point inside each polygon and how it was found; outside its polygon the job fails."""
    found = geo.with_interior_point(polygons.select("geom_id", sides), sides)
    inside = geo.contains(F.col(sides), F.col("x"), F.col("y"))
    checked = F.when(inside, F.col("method")).otherwise(
        F.raise_error(F.lit("an ignition point fell outside its polygon")).cast("string")
    )
    # checked in the projection: a filter would be pushed below every step it is made of
    return found.select("geom_id", "x", "y", checked.alias("method"))


def split_segments(segments: DataFrame, longest: float) -> DataFrame:
    """Segments cut into equal pieces no longer than `longest`, so each stays near its middle."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.ceil(length / F.lit(float(longest))).cast("int"), F.lit(1))
    cut = segments.withColumn("_n", n).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    )

    def at(a: str, b: str, k: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")

    pieces = cut.withColumns(
        {
            "_x1": at("x1", "x2", F.col("_k")),
            "_y1": at("y1", "y2", F.col("_k")),
            "_x2": at("x1", "x2", F.col("_k") + 1),
            "_y2": at("y1", "y2", F.col("_k") + 1),
        }
    )
    return pieces.withColumns({c: F.col(f"_{c}") for c in ("x1", "y1", "x2", "y2")}).drop(
        "_n", "_k", "_x1", "_y1", "_x2", "_y2"
    )


def _bucketed(segments: DataFrame, bucket: float, by: Sequence[str]) -> DataFrame:
    size = F.lit(float(bucket))
    pieces = split_segments(segments.select(*by, "x1", "y1", "x2", "y2"), bucket)
    return pieces.withColumns(
        {
            "_bx": F.floor((F.col("x1") + F.col("x2")) / 2.0 / size),
            "_by": F.floor((F.col("y1") + F.col("y2")) / 2.0 / size),
        }
    ).distinct()


def _around(df: DataFrame, x: str, y: str, bucket: float) -> DataFrame:
    size = F.lit(float(bucket))
    here = F.array(
        *(
            F.struct(
                (F.floor(F.col(x) / size) + dx).alias("_bx"),
                (F.floor(F.col(y) / size) + dy).alias("_by"),
            )
            for dx in (-1, 0, 1)
            for dy in (-1, 0, 1)
        )
    )
    return df.select("*", F.inline(here))


def _piece_distance(x: str, y: str) -> Column:
    return geo.point_segment_distance(
        F.col(x), F.col(y), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    )


#: Pieces that the points of a box are measured against without cutting the box again.
PIECES_OF_BOX = 64
#: How often a square of one bucket is halved, for points and for pieces.
HALVINGS = 7
#: Rows of a staged table of keys up to which it is sent to every executor.
SENT_ROWS = 1 << 14


def _merged(df: DataFrame) -> DataFrame:
    """For joins with staged rows: the planner takes the size of compressed files for theirs.

    Pairs of boxes take a hundredth of their size there, so the driver would gather and send them.
    """
    return df.hint("merge")


def _sent_if_few(staged: DataFrame) -> DataFrame:
    return F.broadcast(staged) if staged.count() <= SENT_ROWS else _merged(staged)


def nearest_distance(
    points: DataFrame,
    segments: DataFrame,
    bucket: float,
    key: Sequence[str],
    x: str = "x",
    y: str = "y",
    by: Sequence[str] = (),
    out: str = "distance",
) -> DataFrame:
    """Distance of each point to the nearest segment of its `by` group; NULL without any.

    Boxes of points, not points, look for their pieces. A box goes down a quadtree of the pieces
    and keeps what may be nearest to some place in it, then all its quarters that hold points do
    the same with the pieces that are left, until few are. A remote box sees all pieces from nearly
    one side, so a handful stays however large or dense the region of the pieces is.
    """
    keys = [*by, *key]
    place = points.select(*keys, F.col(x).alias("_px"), F.col(y).alias("_py"))
    place = cut_lineage(place.where(F.col("_px").isNotNull() & F.col("_py").isNotNull()), "places")
    pieces = cut_lineage(_bucketed(segments, bucket, by), "pieces")
    found = []
    pairs = _pieces_of_boxes(place, pieces, bucket, list(by))
    for halved in range(HALVINGS + 1):
        if pairs is None:
            break
        box = [*by, "_gx", "_gy"]
        placed = _boxed(place, bucket / 2**halved)
        crowded = pairs.groupBy(*box).agg(F.count("*").alias("_n")).where(F.col("_n") > PIECES_OF_BOX)
        crowded = cut_lineage(crowded.select(*box), "crowded-boxes")
        last = halved == HALVINGS or crowded.isEmpty()
        # only the first round has all points
        crowded = _merged(crowded) if halved else _sent_if_few(crowded)
        done = pairs if last else pairs.join(crowded, box, "left_anti")
        measured = placed.join(_merged(done), box).groupBy(*keys).agg(F.min(_piece_distance("_px", "_py")).alias("_d"))
        found.append(cut_lineage(measured, "nearest"))
        if last:
            break
        place = cut_lineage(placed.join(crowded, box, "left_semi").drop("_gx", "_gy"), "places")
        quarters = _boxed(place, bucket / 2 ** (halved + 1)).select(*box).distinct()
        parents = quarters.select(*by, F.col("_gx").alias("_cx"), F.col("_gy").alias("_cy"), F.floor(F.col("_gx") / 2).alias("_gx"), F.floor(F.col("_gy") / 2).alias("_gy"))
        inner = _merged(parents).join(_merged(pairs), box).drop("_gx", "_gy").withColumnsRenamed({"_cx": "_gx", "_cy": "_gy"})
        pairs = _nearer_pieces(inner, bucket / 2 ** (halved + 1), box)
    if not found:
        return points.withColumn(out, F.lit(None).cast("double"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    return points.join(_merged(best.withColumnRenamed("_d", out)), keys, "left")


def _boxed(place: DataFrame, size: float) -> DataFrame:
    return place.withColumns({"_gx": F.floor(F.col("_px") / F.lit(size)), "_gy": F.floor(F.col("_py") / F.lit(size))})


def _may_be_nearest(gap: Column, reached: Column, far: Column, reach: float) -> Column:
    """Whether what is `gap` from the middle of a box may be nearer than a known place to some point in it.

    The known place is `reached` from the middle, which no kept thing is further than, and at most
    `far` from any place of the thing; `reach` is the half diagonal of the box. Along a way of that
    length the lead changes by no more than the directions to both differ.
    """
    both = F.greatest(gap - reach, F.lit(0.0)) + F.greatest(reached - reach, F.lit(0.0))
    turn = F.when(far >= both, F.lit(2.0)).otherwise(2.0 * far / both)
    return gap - reached <= F.lit(reach) * turn + 1e-9 * (reached + reach)


def _middle(size: float) -> tuple[Column, Column]:
    return (F.col("_gx") + 0.5) * F.lit(size), (F.col("_gy") + 0.5) * F.lit(size)


def _pieces_of_boxes(place: DataFrame, pieces: DataFrame, bucket: float, by: list[str]) -> DataFrame | None:
    """(by, _gx, _gy, x1 ... y2): the pieces that may be nearest to a point in a box of one bucket.

    Both sides go down by halves; the boxes of points stay as they are from one bucket on.
    """
    ends = pieces.agg(F.min("_bx").alias("x0"), F.max("_bx").alias("x1"), F.min("_by").alias("y0"), F.max("_by").alias("y1")).first()
    held = _boxed(place, bucket).select(*by, "_gx", "_gy").distinct()
    held = cut_lineage(held, "boxes")
    span = held.agg(F.min("_gx").alias("x0"), F.max("_gx").alias("x1"), F.min("_gy").alias("y0"), F.max("_gy").alias("y1")).first()
    if ends["x0"] is None or span["x0"] is None:
        return None
    x = (F.col("x1") + F.col("x2")) / 2.0
    y = (F.col("y1") + F.col("y2")) / 2.0
    low = {"_lx": F.least("x1", "x2"), "_ly": F.least("y1", "y2"), "_hx": F.greatest("x1", "x2"), "_hy": F.greatest("y1", "y2")}

    def tree(level: int) -> DataFrame:
        """A row a box of pieces: their extent and the ends of theirs that lie furthest to each side.

        A remote box sees the side that faces it, so one of these ends is about as near as the box is.
        """
        size = F.lit(bucket * 2.0**level)
        ends = [[F.struct(*(F.col(f"{c}{k}").alias(f"_r{c}") for c in order)) for k in (1, 2)] for order in ("xy", "yx")]
        outer = {f"_{side}{i}": pick(*both) for i, both in enumerate(ends) for side, pick in (("l", F.least), ("h", F.greatest))}
        rows = pieces.select(*by, F.floor(x / size).alias("_qx"), F.floor(y / size).alias("_qy"), *(c.alias(n) for n, c in (low | outer).items()))
        return rows.groupBy(*by, "_qx", "_qy").agg(*((F.min if n.startswith("_l") else F.max)(n).alias(n) for n in (*low, *outer)))

    widest = max(ends["x1"] - ends["x0"], ends["y1"] - ends["y0"], 1)
    top = math.ceil(math.log2(widest + 1))
    # fine enough for some sixteen pieces a box where they are spread evenly
    counts = pieces.groupBy(*by, "_bx", "_by").agg(F.count("*").alias("_n")).agg(F.avg("_n")).first()[0]
    least = -min(HALVINGS, max(0, math.ceil(math.log(counts / 16, 4)))) if counts > 16 else 0
    open_ = None
    for level in range(top, least - 1, -1):
        grown = max(level, 0)
        size = bucket * 2.0**grown
        boxes = held.select(*by, *(F.floor(F.col(c) / 2**grown).alias(c) for c in ("_gx", "_gy"))).distinct()
        there = tree(level)
        if open_ is None:
            # two by two boxes of pieces at most
            met = boxes.join(_merged(there), by) if by else boxes.crossJoin(F.broadcast(there))
        else:
            child = F.array(*(F.struct((F.col("_qx") * 2 + i).alias("_u"), (F.col("_qy") * 2 + j).alias("_v")) for i in (0, 1) for j in (0, 1)))
            down = open_.select(*by, "_gx", "_gy", F.inline(child)).withColumnsRenamed({"_u": "_qx", "_v": "_qy"})
            if level >= 0:
                parents = boxes.select(*by, F.col("_gx").alias("_cx"), F.col("_gy").alias("_cy"), F.floor(F.col("_gx") / 2).alias("_gx"), F.floor(F.col("_gy") / 2).alias("_gy"))
                down = _merged(parents).join(_merged(down), [*by, "_gx", "_gy"]).drop("_gx", "_gy").withColumnsRenamed({"_cx": "_gx", "_cy": "_gy"})
            met = _merged(down).join(_merged(there), [*by, "_qx", "_qy"])
        cx, cy = _middle(size)
        reach = size * math.sqrt(0.5)
        gap = F.hypot(F.greatest(F.col("_lx") - cx, F.lit(0.0), cx - F.col("_hx")), F.greatest(F.col("_ly") - cy, F.lit(0.0), cy - F.col("_hy")))
        outer = [(F.col(f"{n}._rx"), F.col(f"{n}._ry")) for n in ("_l0", "_h0", "_l1", "_h1")]
        nearest = F.least(*(F.struct(F.hypot(rx - cx, ry - cy).alias("_own"), rx.alias("_rx"), ry.alias("_ry")) for rx, ry in outer))
        box = [*by, "_gx", "_gy"]
        met = met.select(*box, "_qx", "_qy", *low, gap.alias("_gap"), nearest.alias("_nearest"))
        # a box keeps boxes along one side of the region, so the window of a box is small
        met = met.withColumn("_best", F.min("_nearest").over(Window.partitionBy(*box)))
        rx, ry = F.col("_best._rx"), F.col("_best._ry")
        far = F.hypot(F.greatest(F.abs(F.col("_lx") - rx), F.abs(F.col("_hx") - rx)), F.greatest(F.abs(F.col("_ly") - ry), F.abs(F.col("_hy") - ry)))
        kept = met.where(_may_be_nearest(F.col("_gap"), F.col("_best._own"), far, reach))
        open_ = cut_lineage(kept.select(*box, "_qx", "_qy"), "open-boxes")
    size = F.lit(bucket * 2.0**least)
    placed = pieces.select(*by, F.floor(x / size).alias("_qx"), F.floor(y / size).alias("_qy"), "x1", "y1", "x2", "y2")
    return _nearer_pieces(_merged(open_).join(_merged(placed), [*by, "_qx", "_qy"]).drop("_qx", "_qy"), bucket, [*by, "_gx", "_gy"])


def _nearer_pieces(pairs: DataFrame, size: float, box: list[str]) -> DataFrame:
    """The pairs of a box and a piece in which the piece may be nearest to some point in the box."""
    cx, cy = _middle(size)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.coalesce(F.try_divide((cx - F.col("x1")) * dx + (cy - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    met = pairs.withColumns({"_fx": F.col("x1") + t * dx, "_fy": F.col("y1") + t * dy})
    met = met.withColumn("_gap", F.hypot(F.col("_fx") - cx, F.col("_fy") - cy))
    met = cut_lineage(met, "met-pieces")
    best = met.groupBy(*box).agg(F.min(F.struct("_gap", "_fx", "_fy")).alias("_best"))
    known = _merged(met).join(_merged(best), box)
    rx, ry, own = F.col("_best._fx"), F.col("_best._fy"), F.col("_best._gap")
    far = F.greatest(*(F.hypot(F.col(f"x{k}") - rx, F.col(f"y{k}") - ry) for k in (1, 2)))
    kept = known.where(_may_be_nearest(F.col("_gap"), own, far, size * math.sqrt(0.5)))
    return cut_lineage(kept.select(*box, "x1", "y1", "x2", "y2"), "box-pieces")


def within_distance(
    points: DataFrame,
    segments: DataFrame,
    radius: float,
    x: str = "x",
    y: str = "y",
    point: Sequence[str] = ("cell_id",),
    by: Sequence[str] = (),
) -> DataFrame:
    """Distinct (by, point) with a segment nearer than the radius.

    Pieces no longer than the radius have their middle within 1.5 radii of such a point, so
    buckets that wide bring them into the nine around it.
    """
    bucket = 1.5 * radius
    size = F.lit(bucket)
    pieces = split_segments(segments.select(*by, "x1", "y1", "x2", "y2"), radius).withColumns(
        {
            "_bx": F.floor((F.col("x1") + F.col("x2")) / 2.0 / size),
            "_by": F.floor((F.col("y1") + F.col("y2")) / 2.0 / size),
        }
    )
    spread = _around(points.select(*point, F.col(x).alias("_px"), F.col(y).alias("_py")), "_px", "_py", bucket)
    return (
        spread.join(pieces, ["_bx", "_by"])
        .where(_piece_distance("_px", "_py") < radius)
        .select(*by, *point)
        .distinct()
    )


def line_distance_stats(
    cells: DataFrame, spec: GridSpec, segments: DataFrame, per_side: int, bucket: float
) -> DataFrame:
    """Mean and population deviation over a cell's sub-points of the distance to a line."""
    from gridrisk.operators.grid import sub_points

    points = sub_points(cells.select("cell_id"), spec, "cell_id", per_side)
    measured = nearest_distance(points, segments, bucket, ["cell_id", "sub"], "sx", "sy")
    return measured.groupBy("cell_id").agg(
        F.avg("distance").alias("distance_mean"), F.stddev_pop("distance").alias("distance_std")
    )


def cells_within(
    cases: DataFrame, cells: DataFrame, radius: str, case: str, largest: float
) -> DataFrame:
    """Cells centred within each case's own radius, its own cell always among them.

    `largest` is an upper bound of the radii and sets the bucket; a radius above it fails.
    """
    size = F.lit(float(largest))
    checked = cases.where(
        F.when(
            F.col(radius) > largest,
            F.raise_error(F.lit("a radius exceeds the stated largest")).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    spread = _around(
        checked.select(case, radius, F.col("x").alias("_px"), F.col("y").alias("_py")), "_px", "_py", largest
    )
    placed = cells.select(
        "cell_id",
        F.col("x").alias("_cx"),
        F.col("y").alias("_cy"),
        F.floor(F.col("x") / size).alias("_bx"),
        F.floor(F.col("y") / size).alias("_by"),
    )
    near = (
        spread.join(placed, ["_bx", "_by"])
        .where(
            F.hypot(F.col("_cx") - F.col("_px"), F.col("_cy") - F.col("_py")) <= F.col(radius)
        )
        .select(case, "cell_id")
    )
    own = cases.select(case, "cell_id").join(cells.select("cell_id"), "cell_id", "left_semi")
    return near.unionByName(own.select(case, "cell_id")).distinct()


def flanks(
    cells: DataFrame,
    near_below: float,
    away: float,
    reach: float,
    elevation_gap: float,
    road: str = "road_m",
    major: str = "major_m",
) -> DataFrame:
    """Pairs of road-side cells and comparable cells off any road, within reach of one another.

    `cells` carries cell_id, x, y, elevation and both distances.
    """
    size = F.lit(float(reach))
    near = cells.where(F.col(road) < near_below).select(
        F.col("cell_id").alias("near_id"),
        F.col("x").alias("_px"),
        F.col("y").alias("_py"),
        F.col("elevation").alias("_pe"),
    )
    others = cells.where((F.col(road) > away) & (F.col(major) > away)).select(
        F.col("cell_id").alias("flank_id"),
        F.col("x").alias("_cx"),
        F.col("y").alias("_cy"),
        F.col("elevation").alias("_ce"),
        F.floor(F.col("x") / size).alias("_bx"),
        F.floor(F.col("y") / size).alias("_by"),
    )
    return (
        _around(near, "_px", "_py", reach)
        .join(others, ["_bx", "_by"])
        .where(F.hypot(F.col("_cx") - F.col("_px"), F.col("_cy") - F.col("_py")) <= reach)
        .where(F.abs(F.col("_ce") - F.col("_pe")) < elevation_gap)
        .select("near_id", "flank_id")
    )


def kernel_density(
    events: DataFrame, spec: GridSpec, bandwidth: float, by: Sequence[str] = ()
) -> DataFrame:
    """Gaussian kernel count per touched cell and `by` value, in events per square km.

    Events at one place are counted first; each place then reaches the cells whose centre lies
    within four bandwidths along both axes, and the sums combine map-side.
    """
    reach = 4.0 * bandwidth
    places = events.groupBy(*by, "x", "y").agg(F.count("*").alias("_m"))
    size = float(spec.resolution)

    def held(index: Column, last: int) -> Column:
        return F.least(F.greatest(index, F.lit(0)), F.lit(last)).cast("int")

    x, y = F.col("x"), F.col("y")
    # first and last centre inside the square
    c0 = F.ceil((x - reach - spec.xmin) / size - 0.5)
    c1 = F.floor((x + reach - spec.xmin) / size - 0.5)
    r0 = F.ceil((spec.ymax - y - reach) / size - 0.5)
    r1 = F.floor((spec.ymax - y + reach) / size - 0.5)
    framed = places.withColumns({"_c0": c0, "_c1": c1, "_r0": r0, "_r1": r1}).where(
        (F.col("_c1") >= 0)
        & (F.col("_c0") < spec.n_cols)
        & (F.col("_r1") >= 0)
        & (F.col("_r0") < spec.n_rows)
        & (F.col("_c0") <= F.col("_c1"))
        & (F.col("_r0") <= F.col("_r1"))
    )
    spread = framed.withColumn(
        "_row",
        F.explode(
            F.sequence(held(F.col("_r0"), spec.n_rows - 1), held(F.col("_r1"), spec.n_rows - 1))
        ),
    ).withColumn(
        "_col",
        F.explode(
            F.sequence(held(F.col("_c0"), spec.n_cols - 1), held(F.col("_c1"), spec.n_cols - 1))
        ),
    )
    cx, cy = spec.center_at(F.col("_col"), F.col("_row"))
    squared = (cx - x) * (cx - x) + (cy - y) * (cy - y)
    scale = 1e6 / (2.0 * math.pi * bandwidth**2)
    part = F.col("_m") * F.lit(scale) * F.exp(-squared / F.lit(2.0 * bandwidth**2))
    cell = F.col("_row").cast("bigint") * spec.n_cols + F.col("_col")
    return spread.groupBy(*by, cell.alias("cell_id")).agg(F.sum(part).alias("density"))


def history_density(
    events: DataFrame,
    active: DataFrame,
    spec: GridSpec,
    bandwidth: float,
    window: int,
    years: Sequence[int],
) -> DataFrame:
    """Event density of the years before each year, over the mean of the active cells.

    The kernel runs once per event year; a year's field is then sent to the years it counts for.
    """
    yearly = kernel_density(events, spec, bandwidth, by=["year"])
    spread = yearly.select(
        "cell_id",
        "density",
        F.explode(F.sequence(F.col("year") + 1, F.col("year") + window)).alias("year"),
    ).where(F.col("year").between(min(years), max(years)))
    past = spread.groupBy("cell_id", "year").agg(F.sum("density").alias("density"))
    spine = active.select(
        "cell_id", F.explode(F.array(*(F.lit(int(y)) for y in years))).alias("year")
    )
    filled = spine.join(past, ["cell_id", "year"], "left").fillna(0.0, ["density"])
    means = filled.groupBy("year").agg(F.avg("density").alias("_mean"))
    # one row per year
    scaled = F.when(F.col("_mean") > 0, F.col("density") / F.col("_mean")).otherwise(
        F.col("density")
    )
    return filled.join(F.broadcast(means), "year").select(
        "cell_id", F.col("year").cast("smallint").alias("year"), scaled.alias("ignition_density")
    )


def road_segments(features: DataFrame, ref: str = "ref") -> DataFrame:
    """Line features as segments, one row per road number a way carries ("SS349;SS350")."""
    points = F.col("vertices")
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(points) - 2),
        lambda i: F.struct(
            F.get(points, i)["x"].alias("x1"),
            F.get(points, i)["y"].alias("y1"),
            F.get(points, i + 1)["x"].alias("x2"),
            F.get(points, i + 1)["y"].alias("y2"),
        ),
    )
    return (
        features.where(F.size(points) >= 2)
        .withColumn("road", F.explode_outer(F.split(F.coalesce(F.col(ref), F.lit("")), ";")))
        .select("road", F.inline(pairs))
    )


def crop_to_polygon(
    pixels: DataFrame, polygons: DataFrame, margin: float, pixel: Sequence[str], x: str, y: str
) -> DataFrame:
    """Pixels inside a polygon or within a margin of its edge."""
    inside = points_in_polygons(pixels, polygons, 4 * margin, x, y).select(*pixel).distinct()
    rim = polygons.select(F.inline("sides"))
    close = within_distance(pixels, rim, margin, x, y, point=pixel)
    wanted = inside.unionByName(close).distinct()
    return pixels.join(wanted, list(pixel), "left_semi")
