"""The training table: every feature block joined onto the sample spine in one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.calendar import calendar_features
from gridrisk.operators.joins import (
    edition_join,
    heaviest_neighbour,
    interpolate,
    join_to_one,
    preceding_join,
)


@dataclass
class Blocks:
    """Inputs of the assembly; a block that is None is left out."""

    static: Sequence[DataFrame] = field(default_factory=tuple)
    landcover: DataFrame | None = None
    landcover_editions: Sequence[int] = ()
    population: DataFrame | None = None
    population_years: Sequence[int] = ()
    vegetation: DataFrame | None = None
    weights: DataFrame | None = None
    backbone: DataFrame | None = None
    backbone_columns: Sequence[str] = ()
    indices: DataFrame | None = None


def assemble(spine: DataFrame, blocks: Blocks, row_key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Left joins only, each with its arity enforced, so the spine keeps its rows.

    Fire-weather codes come from the heaviest backbone node, never interpolated: they carry
    months of drying of one place. The same call scores a whole grid of days when the spine is
    (cell_id, date).
    """
    out = spine
    for block in blocks.static:
        out = join_to_one(out, block, ["cell_id"])
    year = F.year("date")
    if blocks.landcover is not None:
        out = edition_join(
            out, blocks.landcover, ["cell_id"], "clc_edition", year, blocks.landcover_editions
        )
    if blocks.population is not None:
        out = edition_join(
            out, blocks.population, ["cell_id"], "population_year", year, blocks.population_years
        )
    if blocks.vegetation is not None:
        out = preceding_join(
            out, blocks.vegetation, ["cell_id"], "date", "month", "veg_composite_date"
        )
    if blocks.backbone is not None:
        values = interpolate(
            spine, blocks.weights, blocks.backbone, blocks.backbone_columns, row_key
        )
        out = join_to_one(out, values, list(row_key))
    if blocks.indices is not None:
        nearest = heaviest_neighbour(blocks.weights)
        out = join_to_one(out, nearest, ["cell_id"])
        out = join_to_one(out, blocks.indices, ["era5_id", "date"]).drop("era5_id")
    return join_to_one(out, calendar_features(spine, "date"), ["date"])


def column_contract(df: DataFrame, declared: Mapping[str, bool]) -> dict[str, list[str]]:
    """Declared columns that are missing (unless optional) and columns nobody declared."""
    have = set(df.columns)
    return {
        "missing": sorted(n for n, optional in declared.items() if not optional and n not in have),
        "undeclared": sorted(have - set(declared)),
    }
