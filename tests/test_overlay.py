"""Edges walked through a lattice, and unions of areas, against pixels and plain geometry."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridrisk.operators import overlay, spatial
from gridrisk.operators.grid import GridSpec

RNG = np.random.default_rng(11)


def star(x, y, r, points, turn=1):
    """A star-shaped ring round a centre; a turn of -1 goes the other way."""
    angles = np.sort(RNG.uniform(0, 2 * math.pi, points))[::turn]
    radii = r * RNG.uniform(0.4, 1.0, points)
    return [(x + d * math.cos(a), y + d * math.sin(a)) for a, d in zip(angles, radii, strict=True)]


def sides(*rings):
    return [dict(x1=float(a[0]), y1=float(a[1]), x2=float(b[0]), y2=float(b[1])) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def shapes(spark, rings):
    rows = [(k, sides(*(r if isinstance(r[0], list) else [r]))) for k, r in enumerate(rings)]
    return spark.createDataFrame(rows, "geom_id long, sides array<struct<x1 double, y1 double, x2 double, y2 double>>")


def inside(rings, x, y):
    """Winding number of points, by rays to the west."""
    wind = np.zeros(np.broadcast(x, y).shape, int)
    for e in sides(*rings):
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        if y1 == y2:
            continue
        over = (y1 > y) != (y2 > y)
        at = x1 + (x2 - x1) * (y - y1) / (y2 - y1)
        wind += np.where(over & (at < x), 1 if y2 > y1 else -1, 0)
    return wind != 0


SPEC = GridSpec(100.0, 1300.0, 12, 10, 100.0)


def pixels(rings, fine=50):
    """Share of each cell by the centres of fine x fine pixels."""
    u = (np.arange(SPEC.n_cols * fine) + 0.5) / fine
    v = (np.arange(SPEC.n_rows * fine) + 0.5) / fine
    x, y = 100.0 + u * 100.0, (1300.0 - v * 100.0)[:, None]
    return inside(rings, x, y), fine


def shares(mask, fine):
    return mask.reshape(SPEC.n_rows, fine, SPEC.n_cols, fine).mean(axis=(1, 3)).ravel()


def test_areas_of_polygons_reaching_beyond_the_grid(spark):
    rings = [star(x, y, r, n, turn) for x, y, r, n, turn in ((600, 800, 420, 9, 1), (150, 400, 300, 25, -1), (1290, 1250, 350, 7, 1), (600, 800, 3000, 12, 1), (-500, 0, 200, 5, 1))]
    rings.append([[(300.0, 400.0), (900.0, 400.0), (900.0, 1000.0), (300.0, 1000.0)], [(400.0, 500.0), (400.0, 850.0), (850.0, 850.0), (850.0, 500.0)]])
    out = spatial.polygon_cells(shapes(spark, rings), SPEC).toPandas()
    assert not out.duplicated(["geom_id", "cell_id"]).any()
    for k, ring in enumerate(rings):
        want = shares(*pixels(ring if isinstance(ring[0], list) else [ring]))
        got = out[out["geom_id"] == k].set_index("cell_id")["area"].reindex(range(120)).fillna(0) / 1e4
        assert np.abs(got - want).max() < 0.03
    # a hole with corners inside cells and edges on lattice lines is exact
    assert out[out["geom_id"] == 5]["area"].sum() == pytest.approx(600 * 600 - 450 * 350)


def test_candidates_grow_with_the_outline(spark):
    wide = GridSpec(0.0, 1000.0, 1000, 1000, 1.0)
    square = shapes(spark, [[(10.5, 10.5), (990.5, 10.5), (990.5, 990.5), (10.5, 990.5)]])
    pieces = overlay.walked(spatial.cell_edges(square, wide), ["geom_id"], wide.n_cols, wide.n_rows)
    assert pieces.count() < 4 * 990
    assert spatial.polygon_cells(square, wide).agg(F.sum("area")).first()[0] == pytest.approx(980.0**2)


def test_union_of_overlapping_areas(spark):
    rings = [star(RNG.uniform(100, 1300), RNG.uniform(300, 1300), RNG.uniform(40, 260), int(RNG.integers(3, 9)), int(RNG.choice([1, -1]))) for _ in range(25)]
    rings += [rings[0], [(300.0, 500.0), (700.0, 500.0), (700.0, 900.0), (300.0, 900.0)], [(300.0, 500.0), (500.0, 500.0), (500.0, 900.0), (300.0, 900.0)]]
    frame = shapes(spark, rings)
    mask = np.zeros((500, 600), bool)
    for ring in rings:
        mask |= pixels([ring])[0]
    want = shares(mask, 50)
    out = spatial.area_shares(frame, SPEC, 0.45).toPandas().set_index("cell_id")["fraction"]
    assert np.abs(out.reindex(range(120)).fillna(0) - want).max() < 0.03 and out.max() <= 1 + 1e-9
    # the same when cells are cut again and again before a sweep
    edges = spatial.cell_edges(frame, SPEC).withColumnRenamed("geom_id", "geom").select("geom", "u1", "v1", "u2", "v2", "weight")
    cut = overlay.union_shares(edges, 12, 10, sweep=6, depth=3).toPandas().set_index("cell")["share"]
    assert np.allclose(cut.reindex(range(120)).fillna(0), out.reindex(range(120)).fillna(0), atol=1e-8)
    doubled = spatial.overlapping_cells(frame, SPEC).toPandas()
    assert (doubled["times"] > 1).all() and len(doubled) > 20
    assert spatial.area_shares(frame.limit(0), SPEC, 0.5).count() == 0


def test_points_meet_the_polygons_round_them(spark):
    rings = [star(RNG.uniform(-500, 900), RNG.uniform(-500, 900), RNG.uniform(10, 700), int(RNG.integers(3, 12))) for _ in range(20)]
    # corners and edges on the borders of buckets, and points on them
    rings.append([(0.0, 0.0), (400.0, 0.0), (400.0, 200.0), (0.0, 200.0)])
    xy = np.vstack([RNG.uniform(-900, 1200, (500, 2)), [(x, y) for x in (0.0, 100.0, 250.0, 400.0) for y in (0.0, 100.0, 150.0, 200.0)]])
    points = spark.createDataFrame(pd.DataFrame({"p": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    got = {(r.p, r.geom_id) for r in spatial.points_in_polygons(points, shapes(spark, rings), 100.0).collect()}
    want = set()
    for k, ring in enumerate(rings):
        odd = np.zeros(len(xy), bool)
        for e in sides(ring):
            if e["y1"] != e["y2"]:
                over = (e["y1"] > xy[:, 1]) != (e["y2"] > xy[:, 1])
                odd ^= over & (xy[:, 0] < e["x1"] + (e["x2"] - e["x1"]) * (xy[:, 1] - e["y1"]) / (e["y2"] - e["y1"]))
        want |= {(int(p), k) for p in np.flatnonzero(odd)}
    assert got == want


def test_cells_near_an_outline(spark):
    ring = star(600, 800, 380, 8)
    r = 130.0
    got = {r.cell_id for r in spatial.buffered_cells(shapes(spark, [ring]), SPEC, r).collect()}
    mask, fine = pixels([ring])
    y, x = np.nonzero(mask)
    px, py = 100.0 + (x + 0.5) / fine * 100.0, 1300.0 - (y + 0.5) / fine * 100.0
    for cell in range(120):
        x0, y1 = 100.0 + cell % 12 * 100.0, 1300.0 - cell // 12 * 100.0
        gap = np.hypot(np.maximum(np.maximum(x0 - px, px - x0 - 100.0), 0), np.maximum(np.maximum(y1 - 100.0 - py, py - y1), 0)).min()
        if abs(gap - r) > 4:
            assert (cell in got) == (gap < r), cell
