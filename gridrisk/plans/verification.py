"""Where recorded events fall on the scored grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.operators.ordering import percentile_rank


def temporal_percentile(
    events: DataFrame, scored: DataFrame, reach: int, event: str = "fire_id"
) -> DataFrame:
    """Rank of the event's own day among the days around it, at the event's cell.

    Days are numbered in blocks as long as the window, so an event meets the two or three blocks
    its window touches by an equi-join on cell and block, whatever the reach; the rank within
    those days needs only counts of lower and equal scores. An exploded side looks smaller to the
    planner than it is, so the joins are told to merge.
    """
    width = F.lit(2 * reach + 1)

    def block(day: Column) -> Column:
        return F.floor(F.unix_date(day) / width)

    first, last = F.date_sub("event_date", reach), F.date_add("event_date", reach)
    spread = events.select(event, "cell_id", "event_date", F.explode(F.sequence(block(first), block(last))).alias("_block"))
    placed = scored.withColumn("_block", block(F.col("date")))
    found = spread.hint("merge").join(placed, ["cell_id", "_block"]).where(F.col("date").between(first, last))
    own = found.where(F.col("date") == F.col("event_date")).select(
        event, F.col("raw").alias("own")
    )
    counted = (
        found.join(own.hint("merge"), event)
        .groupBy(event)
        .agg(
            F.count("*").alias("window_days"),
            F.count_if(F.col("raw") < F.col("own")).alias("below"),
            F.count_if(F.col("raw") == F.col("own")).alias("ties"),
        )
    )
    share = (F.col("below") + (F.col("ties") + 1) / 2.0) / F.col("window_days")
    return counted.select(event, "window_days", share.alias("temporal_percentile"))


def verify_events(
    events: DataFrame, scored: DataFrame, raw: str = "raw", thresholds: Sequence[float] = (0.9, 0.99)
) -> DataFrame:
    """Within-day percentiles of the events' cells, summed up per season and overall.

    Every day is ranked in the same job; the events are then a plain join.
    """
    from gridrisk.functions.calendar import season
    from gridrisk.operators.reports import percentile_summary

    days = scored.join(events.select("date").distinct(), "date", "left_semi")
    ranked = percentile_rank(days, ["date"], raw, "percentile")
    found = events.join(ranked, ["cell_id", "date"]).withColumn("season", season(F.month("date")))
    return percentile_summary(found, "season", "percentile", thresholds)


def history_baseline(density: DataFrame, value: str, out: str = "baseline") -> DataFrame:
    """Percentile of each cell's event density over the whole grid."""
    return percentile_rank(density, (), value, out)


def score_cases(
    cases: DataFrame,
    ranked: DataFrame,
    temporal: DataFrame,
    baseline: DataFrame,
    near: DataFrame,
    classes: Column,
    case: str = "case_id",
) -> DataFrame:
    """Every measure of a case: its cell's percentile, the best in reach, class, return period.

    `ranked` carries (cell_id, date, probability, percentile); `near` is (case, cell_id), the
    cells within the case's uncertainty.
    """
    from gridrisk.functions.physics import return_period_years

    around = (
        near.join(cases.select(case, "date"), case)
        .join(ranked.select("cell_id", "date", "percentile"), ["cell_id", "date"])
        .groupBy(case)
        .agg(F.max("percentile").alias("percentile_max"), F.count("*").alias("cells_in_radius"))
    )
    past = (
        near.join(baseline.select("cell_id", "baseline"), "cell_id")
        .groupBy(case)
        .agg(F.max("baseline").alias("baseline_max"))
    )
    own = cases.join(ranked, ["cell_id", "date"]).withColumns(
        {
            "danger_class": classes,
            "return_period_years": return_period_years(F.col("probability")),
        }
    )
    return (
        own.join(around, case, "left")
        .join(baseline, "cell_id", "left")
        .join(past, case, "left")
        .join(temporal, case, "left")
    )
