"""Tagged map features: which lines and points count, and their density per cell."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: highway classes a vehicle can use, and the larger ones among them
VEHICLE_HIGHWAYS = (
    "motorway",
    "trunk",
    "primary",
    "secondary",
    "tertiary",
    "unclassified",
    "residential",
    "living_street",
    "service",
    "track",
    "motorway_link",
    "trunk_link",
    "primary_link",
    "secondary_link",
    "tertiary_link",
)
MAJOR_HIGHWAYS = ("motorway", "trunk", "primary", "secondary")

# fixed values: tag values of the other line layers
RAILWAYS = ("rail", "light_rail", "narrow_gauge", "funicular", "tram")
WATERWAYS = ("river", "stream", "canal", "drain", "ditch")

# fixed values: tourism values that count as recreation and as lodging; some are both
RECREATION = ("alpine_hut", "wilderness_hut", "camp_site", "picnic_site", "information")
LODGING = (
    "hotel",
    "guest_house",
    "bed_and_breakfast",
    "hostel",
    "motel",
    "camp_site",
    "alpine_hut",
    "wilderness_hut",
    "chalet",
    "apartment",
)

LINE_LAYERS = {
    "roads": ("highway", VEHICLE_HIGHWAYS),
    "railways": ("railway", RAILWAYS),
    "waterways": ("waterway", WATERWAYS),
}


def tag(features_tags: str, key: str) -> Column:
    return F.element_at(F.col(features_tags), key)


def lines(features: DataFrame, layer: str, tags: str = "tags", kind: str = "kind") -> DataFrame:
    """Line features of a layer, by the values of its tag."""
    key, allowed = LINE_LAYERS[layer]
    return features.where((F.col(kind) == "line") & tag(tags, key).isin(*allowed))


def major_roads(features: DataFrame, tags: str = "tags", kind: str = "kind") -> DataFrame:
    """Line features of the larger road classes, link roads counted with their class."""
    base = F.regexp_replace(tag(tags, "highway"), "_link$", "")
    return features.where((F.col(kind) == "line") & base.isin(*MAJOR_HIGHWAYS)).withColumn(
        "highway", base
    )


def poi_kinds(tags: str = "tags") -> dict[str, Column]:
    """Which density a point of interest counts in; huts and campsites count in both."""
    tourism = tag(tags, "tourism")
    parking = F.coalesce(tag(tags, "amenity") == "parking", F.lit(False))
    return {
        "recreational_density": F.coalesce(tourism.isin(*RECREATION), F.lit(False)) | parking,
        "lodging_density": F.coalesce(tourism.isin(*LODGING), F.lit(False)),
    }


def poi_points(
    features: DataFrame, tags: str = "tags", vertices: str = "vertices", kind: str = "kind"
) -> DataFrame:
    """Points of interest with one coordinate each: the vertex, or a polygon's centroid."""
    from gridrisk.functions.geometry import centroid, edges

    wanted = tag(tags, "tourism").isNotNull() | (tag(tags, "amenity") == "parking")
    cx, cy = centroid(edges(F.col(vertices)))
    area = F.col(kind) == "polygon"
    first = F.get(vertices, F.lit(0))
    return features.where(wanted & F.col(kind).isin("point", "polygon")).withColumns(
        {
            "x": F.when(area, cx).otherwise(first["x"]),
            "y": F.when(area, cy).otherwise(first["y"]),
        }
    )


def poi_density(
    features: DataFrame, cells: DataFrame, kinds: Mapping[str, Column], cell_km2: float
) -> DataFrame:
    """Points of each kind per square km and cell, 0 where there are none."""
    counts = features.where(F.col("cell_id") >= 0).groupBy("cell_id").agg(
        *(F.count_if(flag).alias(name) for name, flag in kinds.items())
    )
    per_km2 = {
        name: (F.col(name) / F.lit(float(cell_km2))).cast("float") for name in kinds
    }
    return cells.join(counts, "cell_id", "left").fillna(0, list(kinds)).withColumns(per_km2)
