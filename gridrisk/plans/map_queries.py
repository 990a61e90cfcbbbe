"""The read queries behind a risk map, as filters and small aggregates on the scored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.lookup import classify, ladder_percentile
from gridrisk.operators.grid import GridSpec


def day_summaries(
    scored: DataFrame, breaks: Sequence[float], keys: Sequence[str], date: str = "date"
) -> DataFrame:
    """Rows per class, mean and maximum of every scored day, one row per day."""
    assigned = classify(F.col("probability"), breaks)
    counts = [F.count_if(assigned == i).alias(k) for i, k in enumerate(keys)]
    return scored.groupBy(date).agg(
        *counts,
        F.avg("probability").alias("mean_probability"),
        F.max("probability").alias("max_probability"),
    )


def day_top(scored: DataFrame, spec: GridSpec, day: Column, k: int = 10) -> DataFrame:
    """The k most exposed cells of one day with their centres."""
    from gridrisk.operators.ranking import top_k

    x, y = spec.center(F.col("cell_id"))
    best = top_k(
        scored.where(F.col("date") == day), k, F.desc("probability"), F.asc("cell_id")
    )
    return best.withColumns({"x": x, "y": y})


def query_points(
    points: DataFrame,
    scored: DataFrame,
    spec: GridSpec,
    breaks: Sequence[float],
    ladder: DataFrame | None = None,
) -> DataFrame:
    """Points and days with their cell's row, class and record percentile; NULL off the grid."""
    from gridrisk.operators.joins import with_scalars

    cell = spec.cell_of(F.col("x"), F.col("y"))
    placed = points.withColumn("cell_id", F.when(cell >= 0, cell))
    found = placed.join(scored, ["cell_id", "date"], "left")
    out = found.withColumn("danger_class", classify(F.col("probability"), breaks))
    if ladder is not None:
        out = with_scalars(out, ladder).withColumn(
            "record_percentile", ladder_percentile(F.col("probability"), F.col("ladder"))
        )
        out = out.drop("ladder")
    return out


def events_on(events: DataFrame, days: DataFrame, properties: Sequence[str]) -> DataFrame:
    """GeoJSON features of the events of the wanted days, geometry from the vertex column."""
    ring = F.transform("vertices", lambda v: F.array(v["x"], v["y"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(*properties).alias("properties"),
    )
    return events.join(days, "date", "left_semi").select(
        "fire_id", "date", F.to_json(feature).alias("feature")
    )


def freshness(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest day and number of rows of every table."""
    from gridrisk.operators.ranking import union_all

    return union_all(
        [
            df.agg(
                F.lit(name).alias("source"),
                F.to_date(F.max(date)).alias("last_date"),
                F.count(date).alias("rows"),
            )
            for name, (df, date) in tables.items()
        ]
    )


def record_counts(events: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    inside = F.col(year).between(first, last)
    return events.agg(
        F.count_if(inside).alias("in_record"),
        F.count_if(F.col(year) > last).alias("after_record"),
        F.count("*").alias("all"),
    )


def source_catalogue(registry: DataFrame) -> DataFrame:
    """Declared columns per category and how many of them change by day."""
    return registry.groupBy("category").agg(
        F.count("*").alias("columns"),
        F.count_if(F.col("temporal") == "dynamic").alias("dynamic"),
    )


def days_to_compute(scored_days: DataFrame, today: Column, back: int = 30, ahead: int = 10) -> DataFrame:
    """Days of the window around today that no scored table covers yet."""
    span = scored_days.sparkSession.range(1).select(
        F.explode(
            F.sequence(F.date_sub(today, back), F.date_add(today, ahead), F.expr("interval 1 day"))
        ).alias("date")
    )
    return span.join(scored_days.select("date").distinct(), "date", "left_anti")


def extent(vertices: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bounding box of each outline."""
    return vertices.groupBy(*group).agg(
        F.min("x").alias("xmin"),
        F.min("y").alias("ymin"),
        F.max("x").alias("xmax"),
        F.max("y").alias("ymax"),
    )
