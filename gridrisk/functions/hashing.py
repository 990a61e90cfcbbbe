"""Reproducible draws: order and choice come from md5 of a seed and the row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(1 << 60)


def draw_key(seed: int | str | Column, *parts: Column) -> Column:
    """Sixty bits of md5(seed|part|...) as a BIGINT; the same row always draws the same."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws("|", seed, *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(seed: int | str | Column, *parts: Column) -> Column:
    return draw_key(seed, *parts) / F.lit(SPAN)
