"""Pixel tables: quality bits, spectral indices, terrain, monthly composites and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: quality bits of fill, dilated cloud, cirrus, cloud and shadow; and of snow
CLOUD_BITS = (0, 1, 2, 3, 4)
SNOW_BIT = 5

# fixed values: collection-2 scaling of reflectance and of thermal kelvin
REFLECTANCE = (2.75e-5, -0.2)
THERMAL = (0.00341802, 149.0)
KELVIN = 273.15

# fixed values: TM/ETM+ to OLI reflectance, band -> (slope, intercept)
HARMONIZE = {
    "red": (0.9047, 0.0061),
    "nir": (0.8462, 0.0412),
    "swir1": (0.8937, 0.0254),
    "swir2": (0.9071, 0.0172),
}
OLDER_SENSORS = ("LT04", "LT05", "LE07")
NEWER_SENSORS = ("LC08", "LC09")

# fixed values: index -> the two bands of its normalised difference
INDEX_BANDS = {"ndvi": ("nir", "red"), "ndwi": ("nir", "swir1"), "nbr": ("nir", "swir2")}

N_SECTORS = 8


def reject_mask(mask_snow: bool) -> int:
    return sum(1 << bit for bit in (*CLOUD_BITS, *((SNOW_BIT,) if mask_snow else ())))


def quality_bits(qa: Column, mask_snow: bool) -> tuple[Column, Column]:
    """Whether a pixel is clear, and its snow bit where it was seen at all."""
    clear = qa.bitwiseAND(F.lit(reject_mask(mask_snow))) == 0
    seen = qa.bitwiseAND(F.lit(reject_mask(False))) == 0
    snow = F.shiftright(qa, SNOW_BIT).bitwiseAND(F.lit(1)).cast("int")
    return clear, F.when(seen, snow)


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def spectral_indices(scenes: DataFrame, sensor: str) -> DataFrame:
    """Indices and surface temperature per pixel and scene, older sensors brought to the newer.

    Digital numbers come in as red, nir, swir1, swir2 and thermal; an unknown sensor fails.
    """
    older = F.col(sensor).isin(*OLDER_SENSORS)
    known = F.when(older | F.col(sensor).isin(*NEWER_SENSORS), F.lit(True)).otherwise(
        F.raise_error(F.lit("unknown sensor")).cast("boolean")
    )
    bands = {}
    for band, (slope, shift) in HARMONIZE.items():
        value = F.col(band) * F.lit(REFLECTANCE[0]) + F.lit(REFLECTANCE[1])
        bands[band] = F.when(older, value * F.lit(slope) + F.lit(shift)).otherwise(value)
    out = {
        name: normalized_difference(bands[a], bands[b]) for name, (a, b) in INDEX_BANDS.items()
    }
    out["lst"] = F.col("thermal") * F.lit(THERMAL[0]) + F.lit(THERMAL[1]) - F.lit(KELVIN)
    return scenes.where(known).withColumns(out)


def month_composite(
    scenes: DataFrame,
    pixel: Sequence[str],
    cell: str,
    month: str,
    values: Sequence[str],
    clear: str = "clear",
    snow: str = "snow",
) -> DataFrame:
    """Per pixel the median of the clear scenes, then the mean over the pixels of a cell.

    A pixel counts as valid if any scene saw it clear. A pixel has at most a few dozen scenes in
    a month, which bounds the median's buffer.
    """
    per_pixel = scenes.groupBy(*pixel, cell, month).agg(
        *(F.median(F.when(F.col(clear), F.col(v))).alias(v) for v in values),
        F.max(F.col(clear).cast("int")).alias("valid"),
        F.coalesce(F.avg(snow), F.lit(0.0)).alias("snow_mean"),
    )
    return per_pixel.groupBy(cell, month).agg(
        *(F.avg(v).alias(v) for v in values),
        F.avg("valid").alias("valid_fraction"),
        F.avg("snow_mean").alias("snow_fraction"),
    )


def aspect_sector(bearing: Column, n: int = N_SECTORS) -> Column:
    """1 to n, sectors half-open, the first centred on north and wrapping through it."""
    width = 360.0 / n
    return (
        F.floor(F.pmod(bearing + F.lit(width / 2), F.lit(360.0)) / F.lit(width)) + 1
    ).cast("int")


def aspect_components(fractions: Sequence[Column]) -> tuple[Column, Column]:
    """Northness and eastness of a cell off its sector shares; flat ground adds nothing."""
    centers = [math.radians(i * 360.0 / len(fractions)) for i in range(len(fractions))]
    north = reduce(
        lambda a, b: a + b, (f * F.lit(math.cos(c)) for f, c in zip(fractions, centers))
    )
    east = reduce(
        lambda a, b: a + b, (f * F.lit(math.sin(c)) for f, c in zip(fractions, centers))
    )
    return north, east


def class_shares(
    pixels: DataFrame, cell: str, label: str, known: Sequence, prefix: str
) -> DataFrame:
    """Wide shares of known labels per cell, in one aggregate."""
    return pixels.groupBy(cell).agg(
        *(
            (F.count_if(F.col(label) == value) / F.count("*")).alias(f"{prefix}{value}")
            for value in known
        )
    )


def neighbourhood(pixels: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Every pixel with its eight neighbours, wide (z00..z22), edges NULL.

    Each pixel sends its value to the nine places it is a neighbour of; the sums combine map-side,
    so no window over a whole raster row is needed.
    """
    sent = pixels.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        (F.col(row) + dr).alias("row"),
                        (F.col(col) + dc).alias("col"),
                        F.lit(f"z{1 - dr}{1 - dc}").alias("place"),
                    )
                    for dr in (-1, 0, 1)
                    for dc in (-1, 0, 1)
                )
            )
        ).alias("to"),
        F.col(value).alias("value"),
    )
    places = [f"z{i}{j}" for i in range(3) for j in range(3)]
    wide = sent.groupBy(F.col("to.row").alias(row), F.col("to.col").alias(col)).agg(
        *(F.max(F.when(F.col("to.place") == p, F.col("value"))).alias(p) for p in places)
    )
    return wide.where(F.col("z11").isNotNull())


def terrain(pixels: DataFrame, row: str, col: str, height: str, step: float) -> DataFrame:
    """Slope in degrees, downslope bearing, 3x3 relief and a flat flag per pixel.

    Central differences; a pixel on the border of the table has no slope.
    """
    z = neighbourhood(pixels, row, col, height)
    east = (F.col("z12") - F.col("z10")) / F.lit(2.0 * step)
    north = (F.col("z01") - F.col("z21")) / F.lit(2.0 * step)
    places = [F.col(f"z{i}{j}") for i in range(3) for j in range(3)]
    slope = F.degrees(F.atan(F.hypot(east, north)))
    return z.select(
        row,
        col,
        F.col("z11").alias("elevation"),
        slope.alias("slope"),
        F.when(slope > 0, F.pmod(F.degrees(F.atan2(-east, -north)), F.lit(360.0))).alias("aspect"),
        (F.greatest(*places) - F.least(*places)).alias("roughness"),
        (slope == 0).alias("flat"),
    )


def terrain_by_cell(pixels: DataFrame, cell: str) -> DataFrame:
    """Mean and population deviation per cell, and the share of flat and of each sector."""
    sector = aspect_sector(F.col("aspect"))
    stats = []
    for band in ("elevation", "slope", "roughness"):
        stats += [F.avg(band).alias(f"{band}_mean"), F.stddev_pop(band).alias(f"{band}_std")]
    known = F.count("slope")
    return pixels.groupBy(cell).agg(
        *stats,
        F.try_divide(F.count_if("flat"), known).alias("aspect_none"),
        *(
            F.try_divide(F.count_if(~F.col("flat") & (sector == i)), known).alias(f"aspect_{i}")
            for i in range(1, N_SECTORS + 1)
        ),
    )


def population_density(
    pixels: DataFrame, cells: DataFrame, cell: str, count: str, area_km2: Column
) -> DataFrame:
    """Mean pixel density per cell; a pixel without people and a cell without pixels are 0."""
    density = F.coalesce(F.col(count), F.lit(0.0)) / area_km2
    means = pixels.groupBy(cell).agg(F.avg(density).alias("pop_density"))
    return cells.join(means, cell, "left").fillna(0.0, ["pop_density"])
