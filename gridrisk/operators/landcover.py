"""Land-cover classes: shares of coded pixels per cell, regrouping and editions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: CORINE grid code (position, from 1) -> three-digit nomenclature code
CORINE_CODES = (
    111, 112, 121, 122, 123, 124, 131, 132, 133, 141, 142,
    211, 212, 213, 221, 222, 223, 231, 241, 242, 243, 244,
    311, 312, 313, 321, 322, 323, 324, 331, 332, 333, 334, 335,
    411, 412, 421, 422, 423,
    511, 512, 521, 522, 523,
)
N_CLASSES = len(CORINE_CODES)
OUTSIDE_CODE = 48


def parent(code: Column, level: int) -> Column:
    """The one- or two-digit class a grid code belongs to."""
    three = F.get(F.array(*(F.lit(c) for c in CORINE_CODES)), (code - 1).cast("int"))
    return F.floor(three / F.lit(10 ** (3 - level))).cast("int")


def code_share(
    pixels: DataFrame, cell: str, code: str, wanted: Sequence, nodata, out: str = "share"
) -> DataFrame:
    """Share of wanted codes among a cell's valid pixels; NULL where none is valid."""
    valid = F.col(code).isNotNull() & (F.col(code) != F.lit(nodata))
    return pixels.groupBy(cell).agg(
        F.try_divide(
            F.count_if(valid & F.col(code).isin(list(wanted))), F.count_if(valid)
        ).alias(out)
    )


def code_shares(
    pixels: DataFrame, cell: str, code: str, excluded: Sequence[int] = (OUTSIDE_CODE,)
) -> DataFrame:
    """Long form: each class present in a cell with its share of the valid pixels.

    A code outside the nomenclature fails the job.
    """
    valid = pixels.where(F.col(code).isNotNull() & ~F.col(code).isin(list(excluded)))
    known = valid.where(
        F.when(
            ~F.col(code).between(1, N_CLASSES),
            F.raise_error(F.lit("a pixel holds a code outside the nomenclature")).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    counts = known.groupBy(cell, code).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(cell).agg(F.sum("_n").alias("_valid"))
    return counts.join(totals, cell).select(
        cell,
        F.col(code).alias("code"),
        (F.col("_n") / F.col("_valid")).alias("share"),
        F.col("_n").alias("pixels"),
        F.col("_valid").alias("valid_pixels"),
    )


def proportions(
    pixels: DataFrame, cell: str, code: str, codes: Sequence[int], nodata: int, prefix: str = "CLC_"
) -> DataFrame:
    """One row per cell: share of every code, and of each level-2 and level-1 class of them."""
    valid = F.col(code).isNotNull() & ~F.col(code).isin(nodata, OUTSIDE_CODE)
    counted = pixels.groupBy(cell).agg(
        F.count_if(valid).alias("_valid"),
        *(F.count_if(valid & (F.col(code) == c)).alias(f"_c{c}") for c in codes),
    )
    columns = {c: F.col(f"_c{c}") for c in codes}
    share = lambda n: F.try_divide(n, F.col("_valid"))
    out = [share(columns[c]).alias(f"{prefix}{c}") for c in codes]
    for level in (2, 1):
        groups: dict[int, list[int]] = {}
        for c in codes:
            groups.setdefault(CORINE_CODES[c - 1] // 10 ** (3 - level), []).append(c)
        out += [
            share(reduce(lambda a, b: a + b, (columns[c] for c in members))).alias(
                f"{prefix}L{level}_{name}"
            )
            for name, members in groups.items()
        ]
    return counted.select(cell, *out)


def regroup(shares: DataFrame, cell: str, level: int) -> DataFrame:
    """Shares of the parents of the classes: pixels are summed and divided once."""
    return shares.groupBy(cell, parent(F.col("code"), level).alias("parent")).agg(
        (F.sum("pixels") / F.max("valid_pixels")).alias("share")
    )


def stack_editions(
    editions: dict[int, DataFrame], active: DataFrame, cell: str, out: str = "clc_edition"
) -> DataFrame:
    """One block per (cell, edition), active cells only."""
    blocks = [
        frame.withColumn(out, F.lit(year).cast("smallint")) for year, frame in editions.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), blocks)
    return stacked.join(active.select(cell), cell, "left_semi")


def dominant(columns: Sequence[str]) -> Column:
    """Name of the column with the highest share, the first one on a tie."""
    return F.array_max(
        F.array(
            *(
                F.struct(F.col(c).alias("share"), F.lit(-i).alias("place"), F.lit(c).alias("name"))
                for i, c in enumerate(columns)
            )
        )
    )["name"]
