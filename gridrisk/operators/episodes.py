"""Connected groups of extreme cell-days and what happened in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.operators.components import HUB, components
from gridrisk.session import cut_lineage


def hot_cells(scored: DataFrame, raw: str, threshold: Column) -> DataFrame:
    return scored.where(F.col(raw) >= threshold)


def label_components(
    cells: DataFrame,
    day: str = "day",
    row: str = "row",
    col: str = "col",
    out: str = "episode",
    hub: int = HUB,
) -> DataFrame:
    """Label the rows that touch, over days, rows and columns, diagonals included.

    Neighbours meet through an equi-join on the 13 places after a row, and components come from
    alternating stars. Labels are the smallest place of the component.
    """
    # one id per place; the same place makes the same id on every run
    place = F.struct(
        F.col(day).cast("bigint").alias("d"),
        F.col(row).cast("bigint").alias("r"),
        F.col(col).cast("bigint").alias("c"),
    )
    nodes = cut_lineage(cells.select(place.alias("v")).distinct())
    # one of each two opposite directions, as a link has no direction
    steps = [
        (dd, dr, dc)
        for dd in (-1, 0, 1)
        for dr in (-1, 0, 1)
        for dc in (-1, 0, 1)
        if (dd, dr, dc) > (0, 0, 0)
    ]
    around = F.array(
        *(
            F.struct(
                (F.col("v.d") + dd).alias("d"),
                (F.col("v.r") + dr).alias("r"),
                (F.col("v.c") + dc).alias("c"),
            )
            for dd, dr, dc in steps
        )
    )
    links = nodes.select(F.col("v").alias("a"), F.explode(around).alias("b")).join(
        nodes.select(F.col("v").alias("b")), "b", "left_semi"
    )
    roots = components(links, hub=hub).withColumnsRenamed({"node": "v", "root": "label"})
    labels = nodes.join(roots, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
    named = labels.select(
        F.col("v.d").alias("_d"), F.col("v.r").alias("_r"), F.col("v.c").alias("_c"), "label"
    )
    same = (
        (F.col(day) == F.col("_d")) & (F.col(row) == F.col("_r")) & (F.col(col) == F.col("_c"))
    )
    return cells.join(named, same).drop("_d", "_r", "_c").withColumnRenamed("label", out)


def number_episodes(labelled: DataFrame, episode: str = "episode") -> DataFrame:
    """Consecutive numbers from 1 in the order of the components' first row."""
    from gridrisk.operators.ordering import row_ids

    names = labelled.select(episode).distinct()
    numbered = row_ids(names, [F.col(episode)], "_number", start=1)
    return (
        labelled.join(numbered, episode)
        .drop(episode)
        .withColumnRenamed("_number", episode)
    )


def summarize(
    cells: DataFrame,
    events: DataFrame,
    x: Column | None = None,
    y: Column | None = None,
    probability: str = "probability",
) -> DataFrame:
    """Span, size, centre, expected and observed events per episode, with the events' ids.

    Distinct cells are counted after one row per episode and cell has been formed, so an episode
    that holds a third of the rows is still summed in parts.
    """
    centre_x = x if x is not None else F.lit(None).cast("double")
    centre_y = y if y is not None else F.lit(None).cast("double")
    per_cell = cells.groupBy("episode", "cell_id").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count("*").alias("cell_days"),
        F.sum(probability).alias("expected"),
        F.sum(centre_x).alias("sx"),
        F.sum(centre_y).alias("sy"),
    )
    totals = per_cell.groupBy("episode").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count("*").alias("cells"),
        F.sum("cell_days").alias("cell_days"),
        F.sum("expected").alias("expected"),
        (F.sum("sx") / F.sum("cell_days")).alias("x"),
        (F.sum("sy") / F.sum("cell_days")).alias("y"),
    )
    found = cells.select("episode", "cell_id", "date").join(events, ["cell_id", "date"])
    hits = found.groupBy("episode").agg(
        F.count("*").alias("observed"),
        F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ", ").alias("fires"),
    )
    return totals.join(hits, "episode", "left").fillna(0, ["observed"]).fillna("", ["fires"])


def yearly_calibration(
    cells: DataFrame, events: DataFrame, top_hits: DataFrame | None = None
) -> DataFrame:
    """Per year: episodes, cell-days, expected against observed with its exact interval."""
    from gridrisk.functions.statistics import garwood

    year = F.year("date").alias("year")
    totals = cells.groupBy(year, "episode").agg(
        F.count("*").alias("_n"), F.sum("probability").alias("_p")
    )
    sums = totals.groupBy("year").agg(
        F.count("*").alias("episodes"),
        F.sum("_n").alias("cell_days"),
        F.sum("_p").alias("expected"),
    )
    known = events.groupBy(year).agg(
        F.count("*").alias("known_fires"),
        F.array_join(F.sort_array(F.collect_set("origin")), ", ").alias("sources"),
    )
    inside = (
        events.join(cells.select("cell_id", "date"), ["cell_id", "date"])
        .groupBy(year)
        .agg(F.count("*").alias("observed"))
    )
    out = sums.join(known, "year", "left").join(inside, "year", "left")
    if top_hits is not None:
        out = out.join(top_hits, "year", "left").fillna(0, ["known_in_history_top"])
    out = out.fillna(0, ["observed", "known_fires"]).fillna("none", ["sources"])
    return (
        out.withColumn("_b", garwood("observed"))
        .withColumns({"observed_low": F.col("_b.low"), "observed_high": F.col("_b.high")})
        .drop("_b")
    )
