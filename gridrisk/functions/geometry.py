"""Polygons and lines as vertex arrays: areas, centres, predicates and projection as Columns.

A ring is array<struct<x double, y double>>, closed or open. Several rings (holes) go in as one
edge array, since every predicate here works edge by edge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """Segments of a ring as array<struct<x1, y1, x2, y2>>, closing it where it is open."""
    onward = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        onward,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def _fold(items: Column, step) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + step(e))


def signed_area(sides: Column) -> Column:
    return _fold(sides, lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2.0


def centroid(sides: Column) -> tuple[Column, Column]:
    """Area centroid by the shoelace sums, taken about the first vertex to keep the digits."""
    ox, oy = F.get(sides, F.lit(0))["x1"], F.get(sides, F.lit(0))["y1"]

    def cross(e):
        return (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy)

    twice = _fold(sides, cross)
    x = _fold(sides, lambda e: (e["x1"] + e["x2"] - ox * 2.0) * cross(e))
    y = _fold(sides, lambda e: (e["y1"] + e["y2"] - oy * 2.0) * cross(e))
    return (
        ox + F.try_divide(x, twice * 3.0),
        oy + F.try_divide(y, twice * 3.0),
    )


def contains(sides: Column, x: Column, y: Column) -> Column:
    """Crossing number: the point is inside when an odd number of edges lie to its right."""
    crossings = F.size(
        F.filter(
            sides,
            lambda e: ((e["y1"] > y) != (e["y2"] > y))
            & (
                x
                < e["x1"]
                + (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"])
            ),
        )
    )
    return crossings % 2 == 1


def perimeter(sides: Column) -> Column:
    return _fold(sides, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def bounds(sides: Column) -> dict[str, Column]:
    return {
        "minx": F.array_min(F.transform(sides, lambda e: F.least(e["x1"], e["x2"]))),
        "maxx": F.array_max(F.transform(sides, lambda e: F.greatest(e["x1"], e["x2"]))),
        "miny": F.array_min(F.transform(sides, lambda e: F.least(e["y1"], e["y2"]))),
        "maxy": F.array_max(F.transform(sides, lambda e: F.greatest(e["y1"], e["y2"]))),
    }


def with_interior_point(polygons: DataFrame, sides: str = "sides") -> DataFrame:
    """Add x, y and method: the centroid where it lies inside, else a point of the widest span.

    The span is taken half way up, off any vertex lying there: half way then to the next vertex
    above. Each step is its own column, so that no expression is repeated inside another.
    """
    e = F.col(sides)
    ox, oy = F.get(e, F.lit(0))["x1"], F.get(e, F.lit(0))["y1"]
    local = F.transform(
        e,
        lambda s: F.struct(
            (s["x1"] - F.col("_ox")).alias("a"),
            (s["y1"] - F.col("_oy")).alias("b"),
            (s["x2"] - F.col("_ox")).alias("c"),
            (s["y2"] - F.col("_oy")).alias("d"),
        ),
    )
    step = polygons.withColumns({"_ox": ox, "_oy": oy}).withColumn("_local", local)
    step = step.withColumns(
        {
            "_twice": _fold(F.col("_local"), lambda s: s["a"] * s["d"] - s["c"] * s["b"]),
            "_mx": _fold(
                F.col("_local"), lambda s: (s["a"] + s["c"]) * (s["a"] * s["d"] - s["c"] * s["b"])
            ),
            "_my": _fold(
                F.col("_local"), lambda s: (s["b"] + s["d"]) * (s["a"] * s["d"] - s["c"] * s["b"])
            ),
            "_ys": F.transform(e, lambda s: s["y1"]),
        }
    )
    step = step.withColumns(
        {
            "_cx": F.col("_ox") + F.try_divide(F.col("_mx"), F.col("_twice") * 3.0),
            "_cy": F.col("_oy") + F.try_divide(F.col("_my"), F.col("_twice") * 3.0),
            "_mid": (F.array_min("_ys") + F.array_max("_ys")) / 2.0,
        }
    )
    step = step.withColumns(
        {
            "_inside": contains(e, F.col("_cx"), F.col("_cy")),
            "_above": F.array_min(F.filter("_ys", lambda v: v > F.col("_mid"))),
            "_on": F.array_contains("_ys", F.col("_mid")),
        }
    )
    step = step.withColumn(
        "_level",
        F.when(F.col("_on"), (F.col("_mid") + F.col("_above")) / 2.0).otherwise(F.col("_mid")),
    )
    level = F.col("_level")
    crossing = F.filter(e, lambda s: (s["y1"] > level) != (s["y2"] > level))
    step = step.withColumn("_crossing", crossing)
    at = lambda s: s["x1"] + (s["x2"] - s["x1"]) * (level - s["y1"]) / (s["y2"] - s["y1"])
    step = step.withColumn("_cuts", F.array_sort(F.transform("_crossing", at)))
    cuts = F.col("_cuts")
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size(cuts) / 2).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(
            (F.get(cuts, i * 2 + 1) - F.get(cuts, i * 2)).alias("width"),
            (-F.get(cuts, i * 2)).alias("west"),
            ((F.get(cuts, i * 2) + F.get(cuts, i * 2 + 1)) / 2.0).alias("x"),
        ),
    )
    step = step.withColumn("_widest", F.array_max(spans))
    inside = F.col("_inside")
    return step.select(
        *polygons.columns,
        F.when(inside, F.col("_cx")).otherwise(F.col("_widest.x")).alias("x"),
        F.when(inside, F.col("_cy")).otherwise(level).alias("y"),
        F.when(inside, F.lit("centroid")).otherwise(F.lit("representative_point")).alias("method"),
    )


def _clamp_integral(y: Column, low: Column, high: Column) -> Column:
    """Integral over y of clamp(y, low, high) - low, from below `low` up to y."""
    span = high - low
    return (
        F.when(y <= low, F.lit(0.0))
        .when(y >= high, span * span / 2.0 + span * (y - high))
        .otherwise((y - low) * (y - low) / 2.0)
    )


def with_area_under_edges(rows: DataFrame, box: tuple[Column, ...], out: str = "_under") -> DataFrame:
    """Add the signed area under each row's edge (x1, y1, x2, y2) inside a box x0, y0, x1, y1.

    Over all edges of a polygon the absolute sum is the area the polygon shares with the box, by
    Green's theorem; no clipped polygon is built. One step per column keeps the generated methods
    small enough to be compiled.
    """
    x0, y0, x1, y1 = box
    ex1, ey1, ex2, ey2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    step = rows.withColumns(
        {
            "_low": y0,
            "_high": y1,
            "_left": F.greatest(F.least(ex1, ex2), x0),
            "_right": F.least(F.greatest(ex1, ex2), x1),
            "_slope": F.try_divide(ey2 - ey1, ex2 - ex1),
        }
    )
    low, high, left, right = (F.col(c) for c in ("_low", "_high", "_left", "_right"))
    step = step.withColumns(
        {
            "_ya": ey1 + F.col("_slope") * (left - ex1),
            "_yb": ey1 + F.col("_slope") * (right - ex1),
        }
    )
    ya, yb = F.col("_ya"), F.col("_yb")
    step = step.withColumns(
        {
            "_ia": _clamp_integral(ya, low, high),
            "_ib": _clamp_integral(yb, low, high),
            "_flat": F.least(F.greatest((ya + yb) / 2.0, low), high) - low,
            # the exact integral divides by the slope; on a nearly level edge the mid value is exact
            "_steep": F.abs(yb - ya) > (high - low) * 1e-9,
        }
    )
    swept = F.when(
        F.col("_steep"), F.try_divide(F.col("_ib") - F.col("_ia"), F.col("_slope"))
    ).otherwise(F.col("_flat") * (right - left))
    sign = F.when(ex2 > ex1, F.lit(-1.0)).otherwise(F.lit(1.0))
    under = F.when((ex1 != ex2) & (right > left), sign * swept).otherwise(F.lit(0.0))
    spent = ("_low", "_high", "_left", "_right", "_slope", "_ya", "_yb", "_ia", "_ib", "_flat", "_steep")
    return step.withColumn(out, under).drop(*spent)


def point_segment_distance(
    px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column
) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, length), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


# fixed values: WGS84 ellipsoid and the transverse Mercator scale on the central meridian
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0


def _krueger():
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    inverse = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    latitude = (
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    )
    return n, radius, forward, inverse, latitude


def to_utm(lon: Column, lat: Column, zone: int = 32) -> tuple[Column, Column]:
    """WGS84 degrees to northern UTM metres by the Krueger series of third order."""
    n, radius, series, _, _ = _krueger()
    first = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6.0 - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - first * F.atanh(F.lit(first) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    easting, northing = eta, xi
    for j, a in enumerate(series, start=1):
        easting = easting + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        northing = northing + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return (
        F.lit(FALSE_EASTING) + F.lit(SCALE * radius) * easting,
        F.lit(SCALE * radius) * northing,
    )


def from_utm(x: Column, y: Column, zone: int = 32) -> tuple[Column, Column]:
    """Northern UTM metres to WGS84 longitude and latitude."""
    _, radius, _, series, latitude = _krueger()
    xi = y / F.lit(SCALE * radius)
    eta = (x - F.lit(FALSE_EASTING)) / F.lit(SCALE * radius)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(series, start=1):
        xi_p = xi_p - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta_p = eta_p - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    phi = chi
    for j, d in enumerate(latitude, start=1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * j))
    lam = F.atan2(F.sinh(eta_p), F.cos(xi_p))
    return F.degrees(lam) + F.lit(zone * 6.0 - 183.0), F.degrees(phi)
