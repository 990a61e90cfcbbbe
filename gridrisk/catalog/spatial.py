"""Section C: grid and spatial operators. Episodes (C21) are in `statistics`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import (
    N_COLS,
    RES,
    WITH_GRID,
    XMIN,
    YMAX,
    Tables,
)
from gridrisk.functions import geometry as geo
from gridrisk.operators import evaluation as evl
from gridrisk.operators import grid as gd
from gridrisk.operators import landcover as lc
from gridrisk.operators import spatial as sp
from gridrisk.operators import terrain as tr

# orders as points inside their customer's cell, off every cell edge
POINTS = (
    "o_orderkey AS fire_id",
    "o_custkey",
    "6e5 + (o_custkey % 40) * 5e2 + o_orderkey % 500 + 25e-2 AS x",
    "52e5 - (o_custkey - o_custkey % 40) / 40 * 5e2 - o_orderkey % 499 - 25e-2 AS y",
    "1e2 + o_orderkey % 900 + 1e-1 AS r",
    "CAST(year(o_orderdate) AS INT) AS year",
    "CAST(o_orderkey % 12 AS INT) AS cause",
)
WITH_POINTS = f"points AS (SELECT {', '.join(POINTS)} FROM orders)"

# suppliers as straight roads across the grid, some carrying two numbers
ROADS = (
    "s_suppkey AS road_id",
    "6e5 + (s_suppkey * 37 % 200) * 1e2 AS x1",
    "52e5 - (s_suppkey * 53 % 190) * 1e2 AS y1",
    "6e5 + (s_suppkey * 37 % 200) * 1e2 + (s_suppkey % 30 - 15) * 1e2 AS x2",
    "52e5 - (s_suppkey * 53 % 190) * 1e2 - (s_suppkey % 17) * 1e2 AS y2",
    "CASE WHEN s_nationkey % 5 = 0 THEN 'SS1;SS2' WHEN s_nationkey % 5 = 1 THEN 'SS2' "
    "WHEN s_nationkey % 5 = 2 THEN 'SS3' END AS ref",
)
WITH_ROADS = f"roads AS (SELECT {', '.join(ROADS)} FROM supplier)"

SEGMENT_DISTANCE = (
    "sqrt(pow({x} - (x1 + least(greatest(coalesce((({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1) * (x2 - x1)), 2) + "
    "pow({y} - (y1 + least(greatest(coalesce((({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1) * (y2 - y1)), 2))"
)


def points(t: Tables):
    return t.orders.selectExpr(*POINTS)


def roads(t: Tables):
    return t.supplier.selectExpr(*ROADS)


def spec(t: Tables) -> gd.GridSpec:
    rows = -(-t.customer.count() // N_COLS)
    return gd.GridSpec(XMIN, YMAX, N_COLS, rows, RES)


N_ROWS_SQL = "n AS (SELECT CAST(ceil(count(*) / 4e1) AS BIGINT) AS n_rows FROM customer)"


def _ring(*corners):
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))


def diamonds(t: Tables):
    """A square standing on its corner around every point."""
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    ring = _ring((x + r, y), (x, y + r), (x - r, y), (x, y - r))
    return points(t).select(
        F.col("fire_id").alias("geom_id"), "x", "y", "r", geo.edges(ring).alias("sides")
    )


@query(
    "c01_snapped_extent",
    f"WITH {WITH_POINTS} SELECT floor(min(x) / 5e2) * 5e2 AS xmin, ceil(max(y) / 5e2) * 5e2 AS ymax, CAST((ceil(max(x) / 5e2) - floor(min(x) / 5e2)) AS INT) AS n_cols, "
    "CAST((ceil(max(y) / 5e2) - floor(min(y) / 5e2)) AS INT) AS n_rows FROM points",
)
def snapped_extent(t: Tables):
    return gd.snap_extent(points(t), "x", "y", 500.0)


@query(
    "c02_cell_index_and_centre",
    "SELECT c_custkey AS cell_id, c_custkey % 40 AS x_index, c_custkey // 40 AS y_index, 6e5 + (c_custkey % 40) * 5e2 + 25e1 AS x, 52e5 - (c_custkey // 40) * 5e2 - 25e1 AS y FROM customer",
)
def cell_index_and_centre(t: Tables):
    lattice = gd.GridSpec(XMIN, YMAX, N_COLS, 1, RES)
    cell = F.col("c_custkey")
    col, row = lattice.index(cell)
    x, y = lattice.center(cell)
    return t.customer.select(
        cell.alias("cell_id"), col.alias("x_index"), row.alias("y_index"), x.alias("x"), y.alias("y")
    )


@query(
    "c03_point_to_cell",
    f"WITH {WITH_POINTS}, p AS (SELECT fire_id, floor((x - 6e5) / 5e2) AS c, floor((52e5 - (y + 3e3)) / 5e2) AS r FROM points) "
    "SELECT fire_id, CASE WHEN c >= 0 AND c < 40 AND r >= 0 AND r < 20 THEN CAST(r * 40 + c AS BIGINT) ELSE -1 END AS cell_id FROM p",
)
def point_to_cell(t: Tables):
    lattice = gd.GridSpec(XMIN, YMAX, N_COLS, 20, RES)
    cell = lattice.cell_of(F.col("x"), F.col("y") + 3000.0)
    return points(t).select("fire_id", cell.alias("cell_id"))


@query(
    "c04_grid_frame",
    f"WITH {N_ROWS_SQL}, g AS (SELECT unnest(range(0, n_rows * 40)) AS cell_id FROM n), nb AS (SELECT l_partkey AS cell_id, count(*) FILTER (l_linenumber IN (1, 2)) / nullif(count(*) FILTER (l_linenumber <> 7), 0) AS f FROM lineitem GROUP BY 1) "
    "SELECT CAST(g.cell_id AS INT) AS cell_id, CAST(g.cell_id % 40 AS SMALLINT) AS x_index, CAST(g.cell_id // 40 AS INT) AS y_index, coalesce(c.c_nationkey % 5 <> 0, false) AS is_active, "
    "CAST(f AS FLOAT) AS non_burnable_fraction, coalesce(f, 0) >= 4e-1 AS is_non_burnable FROM g LEFT JOIN customer c ON c.c_custkey = g.cell_id LEFT JOIN nb ON nb.cell_id = g.cell_id",
)
def grid_frame(t: Tables):
    pixels = t.lineitem.select(F.col("l_partkey").alias("cell_id"), "l_linenumber")
    fraction = lc.code_share(
        pixels, "cell_id", "l_linenumber", [1, 2], 7, out="non_burnable_fraction"
    )
    frame = gd.grid_frame(t.spark, spec(t), t.grid().where("is_active"), fraction, 0.4)
    return frame.drop("x", "y")


DIAMOND_CELLS = (
    f"WITH {WITH_POINTS}, {N_ROWS_SQL}, b AS (SELECT fire_id, x, y, r, unnest(range(CAST(greatest(floor((x - r - 6e5) / 5e2), 0) AS BIGINT), CAST(least(floor((x + r - 6e5) / 5e2), 39) AS BIGINT) + 1)) AS c FROM points), "
    "d AS (SELECT fire_id, x, y, r, c, unnest(range(CAST(greatest(floor((52e5 - y - r) / 5e2), 0) AS BIGINT), CAST(least(floor((52e5 - y + r) / 5e2), n_rows - 1) AS BIGINT) + 1)) AS w FROM b, n), "
    "e AS (SELECT *, 6e5 + c * 5e2 AS x0, 52e5 - w * 5e2 AS y1 FROM d), "
    "gap AS (SELECT *, greatest(x0 - x, 0, x - x0 - 5e2) + greatest(y1 - 5e2 - y, 0, y - y1) AS l1 FROM e) "
)


@query(
    "c05_polygon_cells",
    DIAMOND_CELLS + "SELECT fire_id AS geom_id, w * 40 + c AS cell_id FROM gap WHERE l1 < r",
)
def polygon_cells(t: Tables):
    return sp.polygon_cells(diamonds(t), spec(t)).select("geom_id", "cell_id")


@query(
    "c05_buffered_box_cells",
    f"WITH {WITH_POINTS}, {N_ROWS_SQL}, b AS (SELECT fire_id, x, y, r, unnest(range(CAST(greatest(floor((x - r - 5e2 - 6e5) / 5e2), 0) AS BIGINT), CAST(least(floor((x + r + 5e2 - 6e5) / 5e2), 39) AS BIGINT) + 1)) AS c FROM points), "
    "d AS (SELECT fire_id, x, y, r, c, unnest(range(CAST(greatest(floor((52e5 - y - r - 5e2) / 5e2), 0) AS BIGINT), CAST(least(floor((52e5 - y + r + 5e2) / 5e2), n_rows - 1) AS BIGINT) + 1)) AS w FROM b, n), "
    "g AS (SELECT fire_id, c, w, greatest(x - r - (6e5 + c * 5e2 + 5e2), 0, 6e5 + c * 5e2 - (x + r)) AS dx, greatest(y - r - (52e5 - w * 5e2), 0, 52e5 - w * 5e2 - 5e2 - (y + r)) AS dy FROM d) "
    "SELECT fire_id AS geom_id, w * 40 + c AS cell_id FROM g WHERE sqrt(dx * dx + dy * dy) < 5e2",
)
def buffered_box_cells(t: Tables):
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    ring = _ring((x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r))
    squares = points(t).select(F.col("fire_id").alias("geom_id"), geo.edges(ring).alias("sides"))
    return sp.buffered_cells(squares, spec(t), 500.0)


@query(
    "c06_points_in_polygons",
    DIAMOND_CELLS + "SELECT w * 40 + c AS cell_id, fire_id AS geom_id FROM gap WHERE w * 40 + c < (SELECT count(*) FROM customer) AND abs(x0 + 25e1 - x) + abs(y1 - 25e1 - y) < r",
)
def points_in_polygons(t: Tables):
    centres = t.grid().select("cell_id", "x", "y")
    areas = diamonds(t).select("geom_id", "sides")
    return sp.points_in_polygons(centres, areas, 1000.0).select("cell_id", "geom_id")


@query(
    "c07_ignition_points",
    f"WITH {WITH_POINTS} SELECT fire_id AS geom_id, round(CASE WHEN fire_id % 2 = 0 THEN x ELSE x + 1e1 END, 4) AS x, round(CASE WHEN fire_id % 2 = 0 THEN y ELSE y + (4e2 + r) / 2 END, 4) AS y, "
    "CASE WHEN fire_id % 2 = 0 THEN 'centroid' ELSE 'representative_point' END AS method FROM points",
)
def ignition_points(t: Tables):
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    whole = _ring((x + r, y), (x, y + r), (x - r, y), (x, y - r))
    high = r + 400.0
    # a thin U, whose centroid lies in its hollow
    hollow = _ring(
        (x, y), (x + 300, y), (x + 300, y + high), (x + 280, y + high),
        (x + 280, y + 20), (x + 20, y + 20), (x + 20, y + high), (x, y + high),
    )
    ring = F.when(F.col("fire_id") % 2 == 0, whole).otherwise(hollow)
    shapes = points(t).select(F.col("fire_id").alias("geom_id"), geo.edges(ring).alias("sides"))
    out = sp.ignition_points(shapes)
    return out.select("geom_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "method")


@query(
    "c08_area_share",
    f"WITH {WITH_GRID}, {N_ROWS_SQL}, f AS (SELECT cell_id, x_index, y_index, 1e2 + x_index * 5e2 AS a, 1e2 + x_index * 5e2 + 3e2 + cell_id % 500 AS b FROM grid), "
    "s AS (SELECT y_index * 40 + k AS cell_id, greatest(least(b, k * 5e2 + 5e2) - greatest(a, k * 5e2), 0) * 25e1 / 25e4 AS part FROM f, range(0, 40) g(k) WHERE k BETWEEN x_index AND x_index + 2) "
    "SELECT cell_id, round(sum(part), 9) AS fraction, sum(part) >= 45e-2 AS is_covered FROM s WHERE part > 0 GROUP BY cell_id",
)
def area_share(t: Tables):
    left = F.lit(6e5 + 100.0) + F.col("x_index") * 500.0
    right = left + 300.0 + F.col("cell_id") % 500
    # even columns lie in the upper half of their row, odd ones in the lower, so none overlap
    top = F.lit(52e5) - F.col("y_index") * 500.0 - (F.col("x_index") % 2) * 250.0
    low = top - 250.0
    ring = _ring((left, low), (right, low), (right, top), (left, top))
    lakes = t.grid().select(F.col("cell_id").alias("geom_id"), geo.edges(ring).alias("sides"))
    out = sp.area_shares(lakes, spec(t), 0.45)
    return out.withColumn("fraction", F.round("fraction", 9))


OVERLAP_SQL = (
    f"WITH {WITH_GRID}, {N_ROWS_SQL}, f AS (SELECT cell_id, 1e2 + x_index * 5e2 - cell_id % 7 * 5e1 AS a, 1e2 + x_index * 5e2 + 3e2 + cell_id % 700 AS b, "
    "y_index * 5e2 + cell_id % 3 * 1e2 AS top, y_index * 5e2 + cell_id % 3 * 1e2 + 45e1 + cell_id % 5 * 1e2 AS low FROM grid), "
    # every cut of a cell by the edges of the boxes that meet it, in whole steps of 50 by 1 metres at the finest
    "cells AS (SELECT r * 40 + k AS cell_id, k * 5e2 AS x0, r * 5e2 AS y0, greatest(a, k * 5e2) AS a, least(b, k * 5e2 + 5e2) AS b, greatest(top, r * 5e2) AS top, least(low, r * 5e2 + 5e2) AS low "
    "FROM f, n, range(0, 40) g(k), range(0, n_rows) h(r) WHERE a < k * 5e2 + 5e2 AND b > k * 5e2 AND top < r * 5e2 + 5e2 AND low > r * 5e2), "
    "ys AS (SELECT DISTINCT cell_id, y FROM (SELECT cell_id, top AS y FROM cells UNION ALL SELECT cell_id, low FROM cells)), "
    "bands AS (SELECT cell_id, y, lead(y) OVER (PARTITION BY cell_id ORDER BY y) AS y2 FROM ys), "
    "hit AS (SELECT c.cell_id, g.y, g.y2, c.a, c.b FROM bands g JOIN cells c ON c.cell_id = g.cell_id AND c.top <= g.y AND c.low >= g.y2), "
    "runs AS (SELECT *, max(b) OVER (PARTITION BY cell_id, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit), "
    "area AS (SELECT cell_id, sum((y2 - y) * greatest(b - greatest(a, coalesce(reach, a)), 0)) / 25e4 AS fraction, sum((y2 - y) * (b - a)) / 25e4 AS added FROM runs GROUP BY cell_id) "
)


def overlapping_boxes(t: Tables):
    """A box for every cell, up to three cells wide and two high, so that neighbours overlap."""
    cell, size = F.col("cell_id"), F.lit(500.0)
    left = F.lit(6e5 + 100.0) + F.col("x_index") * size - cell % 7 * 50.0
    right = F.lit(6e5 + 100.0) + F.col("x_index") * size + 300.0 + cell % 700
    top = F.lit(52e5) - F.col("y_index") * size - cell % 3 * 100.0
    low = top - 450.0 - cell % 5 * 100.0
    ring = _ring((left, low), (right, low), (right, top), (left, top))
    return t.grid().select(cell.alias("geom_id"), geo.edges(ring).alias("sides"))


@query(
    "c08_overlapping_share",
    OVERLAP_SQL + "SELECT cell_id, round(fraction, 9) AS fraction, fraction >= 45e-2 AS is_covered FROM area WHERE fraction > 1e-9",
)
def overlapping_share(t: Tables):
    out = sp.area_shares(overlapping_boxes(t), spec(t), 0.45)
    return out.withColumn("fraction", F.round("fraction", 9))


@query(
    "c08_overlapping_cells",
    OVERLAP_SQL + "SELECT cell_id, round(added / fraction, 6) AS times FROM area WHERE added > fraction + 1e-9",
)
def overlapping_cells(t: Tables):
    return sp.overlapping_cells(overlapping_boxes(t), spec(t)).withColumn("times", F.round("times", 6))


@query(
    "c08_area_conserved",
    f"WITH {WITH_POINTS}, {N_ROWS_SQL} SELECT fire_id AS geom_id, round(2 * r * r, 2) AS area FROM points, n WHERE x - r > 6e5 AND x + r < 62e4 AND y + r < 52e5 AND y - r > 52e5 - n_rows * 5e2",
)
def area_conserved(t: Tables):
    grid = spec(t)
    low = YMAX - grid.n_rows * RES
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    inside = (x - r > XMIN) & (x + r < XMIN + N_COLS * RES) & (y + r < YMAX) & (y - r > low)
    cells = sp.polygon_cells(diamonds(t).where(inside).select("geom_id", "sides"), grid, tolerance=0)
    return cells.groupBy("geom_id").agg(F.round(F.sum("area"), 2).alias("area"))


@query(
    "c09_coded_pixel_share",
    "SELECT l_suppkey AS cell_id, round(count(*) FILTER (l_linenumber IN (1, 2)) / nullif(count(*) FILTER (l_linenumber <> 7), 0), 9) AS share FROM lineitem GROUP BY 1",
)
def coded_pixel_share(t: Tables):
    pixels = t.lineitem.select(F.col("l_suppkey").alias("cell_id"), "l_linenumber")
    out = lc.code_share(pixels, "cell_id", "l_linenumber", [1, 2], 7)
    return out.withColumn("share", F.round("share", 9))


@query(
    "c10_class_proportions",
    "WITH v AS (SELECT l_suppkey AS cell_id, l_linenumber AS code, count(*) FILTER (l_linenumber <> 6) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT cell_id, "
    + ", ".join(
        f"round(count(*) FILTER (code = {c}) / any_value(n), 9) AS clc_{c}" for c in (1, 2, 3, 4, 5, 7)
    )
    + ", round(count(*) FILTER (code <= 2) / any_value(n), 9) AS clc_l2_11, round(count(*) FILTER (code BETWEEN 3 AND 5) / any_value(n), 9) AS clc_l2_12, round(count(*) FILTER (code = 7) / any_value(n), 9) AS clc_l2_13, "
    "round(count(*) FILTER (code <> 6) / any_value(n), 9) AS clc_l1_1 FROM v GROUP BY cell_id",
)
def class_proportions(t: Tables):
    pixels = t.lineitem.select(F.col("l_suppkey").alias("cell_id"), "l_linenumber")
    out = lc.proportions(pixels, "cell_id", "l_linenumber", (1, 2, 3, 4, 5, 7), nodata=6, prefix="clc_")
    names = {c: c.replace("_L", "_l") for c in out.columns}
    return out.select(
        "cell_id", *(F.round(c, 9).alias(names[c]) for c in out.columns if c != "cell_id")
    )


@query(
    "c11_edition_stack",
    f"WITH {WITH_GRID}, e AS (SELECT l_suppkey AS cell_id, CASE WHEN year(l_shipdate) < 1998 THEN 1994 ELSE 2000 END AS ed, l_linenumber FROM lineitem) "
    "SELECT cell_id, CAST(ed AS SMALLINT) AS clc_edition, round(count(*) FILTER (l_linenumber = 1) / count(*), 9) AS share FROM e WHERE cell_id IN (SELECT cell_id FROM grid WHERE is_active) GROUP BY 1, 2",
)
def edition_stack(t: Tables):
    pixels = t.lineitem.select(
        F.col("l_suppkey").alias("cell_id"), "l_linenumber", F.year("l_shipdate").alias("year")
    )
    blocks = {
        1994: lc.code_share(pixels.where("year < 1998"), "cell_id", "l_linenumber", [1], 99),
        2000: lc.code_share(pixels.where("year >= 1998"), "cell_id", "l_linenumber", [1], 99),
    }
    out = lc.stack_editions(blocks, t.grid().where("is_active"), "cell_id")
    return out.withColumn("share", F.round("share", 9))


@query(
    "c12_sub_points",
    "SELECT c_custkey AS cell_id, CAST(i * 5 + j AS INT) AS sub, round(6e5 + (c_custkey % 40) * 5e2 + (j + 5e-1) / 5 * 5e2, 6) AS sx, round(52e5 - (c_custkey // 40) * 5e2 - (i + 5e-1) / 5 * 5e2, 6) AS sy "
    "FROM customer, range(0, 5) a(i), range(0, 5) b(j)",
)
def sub_points(t: Tables):
    lattice = gd.GridSpec(XMIN, YMAX, N_COLS, 1, RES)
    out = gd.sub_points(t.grid().select("cell_id"), lattice, "cell_id", 5)
    return out.select("cell_id", "sub", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query(
    "c13_line_distance",
    f"WITH {WITH_ROADS}, s AS (SELECT c_custkey AS cell_id, 6e5 + (c_custkey % 40) * 5e2 + (j + 5e-1) / 5 * 5e2 AS sx, 52e5 - (c_custkey // 40) * 5e2 - (i + 5e-1) / 5 * 5e2 AS sy FROM customer, range(0, 5) a(i), range(0, 5) b(j)), "
    f"d AS (SELECT cell_id, sx, sy, min({SEGMENT_DISTANCE.format(x='sx', y='sy')}) AS d FROM s, roads GROUP BY 1, 2, 3) SELECT cell_id, round(avg(d), 4) AS distance_mean, round(stddev_pop(d), 4) AS distance_std FROM d GROUP BY cell_id",
)
def line_distance(t: Tables):
    lattice = gd.GridSpec(XMIN, YMAX, N_COLS, 1, RES)
    out = sp.line_distance_stats(t.grid(), lattice, roads(t), 5, 4000.0)
    return out.select(
        "cell_id", *(F.round(c, 4).alias(c) for c in ("distance_mean", "distance_std"))
    )


@query(
    "c14_poi_density",
    f"WITH {WITH_GRID}, {WITH_POINTS}, p AS (SELECT o_custkey AS cell_id, count(*) FILTER (cause IN (1, 2, 3)) AS a, count(*) FILTER (cause IN (3, 4)) AS b FROM points GROUP BY 1) "
    "SELECT g.cell_id, CAST(coalesce(a, 0) / 25e-2 AS FLOAT) AS recreational_density, CAST(coalesce(b, 0) / 25e-2 AS FLOAT) AS lodging_density FROM grid g LEFT JOIN p USING (cell_id) WHERE is_active",
)
def poi_density(t: Tables):
    from gridrisk.sources.features import poi_density as density

    grid = spec(t)
    features = points(t).withColumn("cell_id", grid.cell_of(F.col("x"), F.col("y")))
    kinds = {
        "recreational_density": F.col("cause").isin(1, 2, 3),
        "lodging_density": F.col("cause").isin(3, 4),
    }
    return density(features, t.grid().where("is_active").select("cell_id"), kinds, 0.25)


KERNEL_SQL = (
    f"{WITH_POINTS}, {N_ROWS_SQL}, cells AS (SELECT unnest(range(0, n_rows * 40)) AS cell_id FROM n), g AS (SELECT cell_id, 6e5 + (cell_id % 40) * 5e2 + 25e1 AS cx, 52e5 - (cell_id // 40) * 5e2 - 25e1 AS cy FROM cells), "
    "k AS (SELECT year, cell_id, sum(1e6 / (2 * pi() * 6e2 * 6e2) * exp(-(pow(cx - x, 2) + pow(cy - y, 2)) / (2 * 6e2 * 6e2))) AS density FROM points JOIN g ON cx BETWEEN x - 24e2 AND x + 24e2 AND cy BETWEEN y - 24e2 AND y + 24e2 GROUP BY 1, 2)"
)


@query(
    "c15_kernel_density",
    f"WITH {KERNEL_SQL} SELECT cell_id, round(sum(density), 6) AS density FROM k GROUP BY cell_id",
)
def kernel_density(t: Tables):
    out = sp.kernel_density(points(t), spec(t), 600.0)
    return out.withColumn("density", F.round("density", 6))


@query(
    "c16_history_density",
    f"WITH {KERNEL_SQL}, {WITH_GRID}, y AS (SELECT unnest(range(1995, 2003)) AS year), s AS (SELECT c.cell_id, y.year, coalesce((SELECT sum(density) FROM k WHERE k.cell_id = c.cell_id AND k.year < y.year AND k.year >= y.year - 3), 0) AS d FROM (SELECT cell_id FROM grid WHERE is_active) c CROSS JOIN y), "
    "m AS (SELECT year, avg(d) AS mean FROM s GROUP BY year) SELECT cell_id, CAST(s.year AS SMALLINT) AS year, round(CASE WHEN mean > 0 THEN d / mean ELSE d END, 6) AS ignition_density FROM s JOIN m USING (year)",
)
def history_density(t: Tables):
    active = t.grid().where("is_active")
    out = sp.history_density(points(t), active, spec(t), 600.0, 3, range(1995, 2003))
    return out.withColumn("ignition_density", F.round("ignition_density", 6))


@query(
    "c17_cells_within",
    f"WITH {WITH_GRID}, {WITH_POINTS} SELECT DISTINCT fire_id AS case_id, g.cell_id FROM points p JOIN grid g ON sqrt(pow(g.x - p.x, 2) + pow(g.y - p.y, 2)) <= r OR g.cell_id = o_custkey WHERE is_active",
)
def cells_within(t: Tables):
    cases = points(t).select(
        F.col("fire_id").alias("case_id"), F.col("o_custkey").alias("cell_id"), "x", "y", "r"
    )
    return sp.cells_within(cases, t.grid().where("is_active"), "r", "case_id", 1001.0)


@query(
    "c18_road_corridors",
    f"WITH {WITH_GRID}, {WITH_ROADS}, s AS (SELECT unnest(string_split(ref, ';')) AS road, x1, y1, x2, y2 FROM roads) SELECT DISTINCT road, cell_id FROM grid, s WHERE {SEGMENT_DISTANCE.format(x='x', y='y')} < 1e3",
)
def road_corridors(t: Tables):
    lines = roads(t).select(
        "ref",
        F.array(
            F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
            F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")),
        ).alias("vertices"),
    )
    segments = sp.road_segments(lines).where(F.col("road") != "")
    return sp.within_distance(t.grid(), segments, 1000.0, by=["road"])


@query(
    "c19_flanks",
    f"WITH {WITH_GRID}, {WITH_ROADS}, d AS (SELECT cell_id, x, y, elevation, min({SEGMENT_DISTANCE.format(x='x', y='y')}) FILTER (ref LIKE '%SS1%') AS road_m, min({SEGMENT_DISTANCE.format(x='x', y='y')}) AS major_m FROM grid, roads GROUP BY ALL) "
    "SELECT a.cell_id AS near_id, b.cell_id AS flank_id FROM d a JOIN d b ON a.road_m < 5e2 AND b.road_m > 6e2 AND b.major_m > 6e2 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 3e3 AND abs(a.elevation - b.elevation) < 15e1",
)
def flanks(t: Tables):
    cells = t.grid().select("cell_id", "x", "y", "elevation")
    lines = roads(t)
    near = sp.nearest_distance(
        cells, lines.where("ref LIKE '%SS1%'"), 4000.0, ["cell_id"], out="road_m"
    )
    both = sp.nearest_distance(
        cells.select("cell_id", "x", "y"), lines, 4000.0, ["cell_id"], out="major_m"
    ).select("cell_id", "major_m")
    return sp.flanks(near.join(both, "cell_id"), 500.0, 600.0, 3000.0, 150.0)


@query(
    "c20_built_up_distance",
    f"WITH {WITH_GRID}, e AS (SELECT *, elevation + 1e2 * ed AS h, ed FROM grid, range(0, 3) r(ed)) SELECT CAST(a.ed AS INT) AS edition, a.cell_id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 4) AS built_up_m "
    "FROM e a LEFT JOIN e b ON a.ed = b.ed AND b.h >= 21e2 GROUP BY 1, 2",
)
def built_up_distance(t: Tables):
    cells = (
        t.grid()
        .withColumn("edition", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("h", F.col("elevation") + F.col("edition") * 100.0)
    )
    built = cells.where(F.col("h") >= 2100.0).select(
        "edition",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("x").alias("x2"),
        F.col("y").alias("y2"),
    )
    out = sp.nearest_distance(
        cells.select("edition", "cell_id", "x", "y"), built, 4000.0, ["cell_id"], by=["edition"]
    )
    return out.select("edition", "cell_id", F.round("distance", 4).alias("built_up_m"))


@query(
    "c22_spatial_blocks",
    f"WITH {WITH_GRID}, b AS (SELECT cell_id, floor(x / 2e3) AS bx, floor(y / 2e3) AS yb FROM grid) SELECT cell_id, CAST((yb - min(yb) OVER ()) * (max(bx) OVER () - min(bx) OVER () + 1) + (bx - min(bx) OVER ()) AS BIGINT) AS block FROM b",
)
def spatial_blocks(t: Tables):
    return evl.block_id(t.grid(), "x", "y", 2000.0).select("cell_id", "block")


@query(
    "c23_bilinear_weights",
    f"WITH {WITH_GRID}, p AS (SELECT cell_id, (x - 6e5) / 3e3 AS c, (52e5 - y) / 3e3 AS r FROM grid), q AS (SELECT *, least(greatest(floor(c), 0), 4) AS l, least(greatest(floor(r), 0), 3) AS w FROM p), "
    "f AS (SELECT *, least(greatest(c - l, 0), 1) AS fx, least(greatest(r - w, 0), 1) AS fy FROM q), s AS (SELECT cell_id, unnest([w * 6 + l, w * 6 + l + 1, w * 6 + l + 6, w * 6 + l + 7]) AS era5_id, "
    "unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS weight FROM f) SELECT cell_id, CAST(era5_id AS BIGINT) AS era5_id, round(weight, 9) AS weight FROM s WHERE weight > 0",
)
def bilinear_weights(t: Tables):
    lattice = gd.Lattice(lon0=6e5, lat0=52e5, step=3e3, n_cols=6, n_rows=5)
    out = gd.bilinear_weights(t.grid(), lattice, "cell_id", "x", "y")
    return out.withColumn("weight", F.round("weight", 9))


@query(
    "c24_nearest_node",
    f"WITH {WITH_GRID} SELECT cell_id, CAST(round((x - 60025e1) / 5e2) AS INT) AS col, CAST(round((519975e1 - y) / 5e2) AS INT) AS row FROM grid",
)
def nearest_node(t: Tables):
    return t.grid().select(
        "cell_id",
        gd.nearest_node(F.col("x"), 600250.0, 500.0).alias("col"),
        gd.nearest_node(F.col("y"), 5199750.0, -500.0).alias("row"),
    )


@query(
    "c25_crop_to_polygon",
    f"WITH {WITH_GRID}, {WITH_ROADS}, box AS (SELECT x1 AS a, y1 AS b FROM roads) SELECT DISTINCT cell_id FROM grid, box WHERE sqrt(pow(greatest(a - 5e2 - x, 0, x - a - 5e2), 2) + pow(greatest(b - 5e2 - y, 0, y - b - 5e2), 2)) < 3e2",
)
def crop_to_polygon(t: Tables):
    x, y = F.col("x1"), F.col("y1")
    ring = _ring((x - 500, y - 500), (x + 500, y - 500), (x + 500, y + 500), (x - 500, y + 500))
    squares = roads(t).select(F.col("road_id").alias("geom_id"), geo.edges(ring).alias("sides"))
    out = sp.crop_to_polygon(t.grid(), squares, 300.0, ["cell_id"], "x", "y")
    return out.select("cell_id")


DEM_SQL = (
    f"{WITH_GRID}, z AS (SELECT x_index AS col, y_index AS row, elevation AS h, cell_id FROM grid), s AS (SELECT c.cell_id, c.row, c.col, c.h, (e.h - w.h) / 1e3 AS de, (n.h - s.h) / 1e3 AS dn FROM z c "
    "LEFT JOIN z e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN z w ON w.row = c.row AND w.col = c.col - 1 LEFT JOIN z n ON n.col = c.col AND n.row = c.row - 1 LEFT JOIN z s ON s.col = c.col AND s.row = c.row + 1), "
    "r AS (SELECT c.row, c.col, max(o.h) - min(o.h) AS rough FROM z c JOIN z o ON abs(o.row - c.row) <= 1 AND abs(o.col - c.col) <= 1 GROUP BY 1, 2), "
    "t AS (SELECT row, col, h, degrees(atan(sqrt(de * de + dn * dn))) AS slope, ((degrees(atan2(-de, -dn)) % 360) + 360) % 360 AS aspect, rough FROM s JOIN r USING (row, col))"
)


@query(
    "c26_terrain",
    f"WITH {DEM_SQL} SELECT row, col, round(h, 6) AS elevation, round(slope, 6) AS slope, CASE WHEN slope > 0 THEN round(aspect, 6) END AS aspect, round(rough, 6) AS roughness FROM t",
)
def terrain(t: Tables):
    pixels = t.grid().select(
        F.col("y_index").alias("row"), F.col("x_index").alias("col"), "elevation"
    )
    out = tr.terrain(pixels, "row", "col", "elevation", 500.0)
    return out.select(
        "row", "col", *(F.round(c, 6).alias(c) for c in ("elevation", "slope", "aspect", "roughness"))
    )


@query(
    "c26_terrain_by_cell",
    f"WITH {DEM_SQL} SELECT (row // 4) * 10 + col // 4 AS cell_id, round(avg(h), 6) AS elevation_mean, round(stddev_pop(h), 6) AS elevation_std, round(avg(slope), 6) AS slope_mean, round(avg(rough), 6) AS roughness_mean, "
    "round(count(*) FILTER (slope > 0 AND floor((aspect + 225e-1) % 36e1 / 45e0) = 0) / nullif(count(slope), 0), 9) AS aspect_1 FROM t GROUP BY 1",
)
def terrain_by_cell(t: Tables):
    pixels = t.grid().select(
        F.col("y_index").alias("row"), F.col("x_index").alias("col"), "elevation"
    )
    shaped = tr.terrain(pixels, "row", "col", "elevation", 500.0)
    cell = F.floor(F.col("row") / 4).cast("int") * 10 + F.floor(F.col("col") / 4).cast("int")
    out = tr.terrain_by_cell(shaped.withColumn("cell_id", cell), "cell_id")
    names = ("elevation_mean", "elevation_std", "slope_mean", "roughness_mean")
    return out.select(
        "cell_id",
        *(F.round(c, 6).alias(c) for c in names),
        F.round("aspect_1", 9).alias("aspect_1"),
    )


@query(
    "c27_population_density",
    f"WITH {WITH_GRID}, p AS (SELECT l_partkey AS cell_id, avg(coalesce(CASE WHEN l_linenumber <> 4 THEN l_quantity END, 0) / 1e-2) AS d FROM lineitem GROUP BY 1) SELECT cell_id, round(coalesce(d, 0), 6) AS pop_density FROM grid LEFT JOIN p USING (cell_id)",
)
def population_density(t: Tables):
    pixels = t.lineitem.select(
        F.col("l_partkey").alias("cell_id"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("people"),
    )
    out = tr.population_density(
        pixels, t.grid().select("cell_id"), "cell_id", "people", F.lit(0.01)
    )
    return out.withColumn("pop_density", F.round("pop_density", 6))
