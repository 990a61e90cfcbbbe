"""Section J: read queries over the scored grid, and day scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk.catalog.aggregates import BREAKS, CLASS_SQL, CLASSES
from gridrisk.catalog.registry import query
from gridrisk.catalog.spatial import WITH_POINTS, points, spec
from gridrisk.catalog.standins import (
    WITH_CELL_DAYS,
    WITH_FIRES,
    WITH_GRID,
    Tables,
)
from gridrisk.operators import ordering
from gridrisk.plans import map_queries as mq


def scored(t: Tables):
    return t.cell_days().select("cell_id", "date", F.col("raw").alias("probability"))


@query(
    "j01_day_summary",
    f"WITH {WITH_CELL_DAYS}, c AS (SELECT date, raw, {CLASS_SQL.format(v='raw')} AS k FROM cell_days) SELECT date, "
    + ", ".join(f"count(*) FILTER (k = {i}) AS {n}" for i, n in enumerate(CLASSES))
    + ", round(avg(raw), 9) AS mean_probability, max(raw) AS max_probability FROM c GROUP BY date",
)
def day_summary(t: Tables):
    out = mq.day_summaries(scored(t), BREAKS, CLASSES)
    return out.withColumn("mean_probability", F.round("mean_probability", 9))


@query(
    "j01_day_top",
    f"WITH {WITH_CELL_DAYS} SELECT cell_id, date, raw AS probability, 6e5 + (cell_id % 40 + 5e-1) * 5e2 AS x, 52e5 - (cell_id // 40 + 5e-1) * 5e2 AS y FROM cell_days "
    "WHERE date = DATE '1999-08-15' ORDER BY raw DESC, cell_id LIMIT 10",
)
def day_top(t: Tables):
    return mq.day_top(scored(t), spec(t), F.lit("1999-08-15").cast("date"))


@query(
    "j02_point_query",
    f"WITH {WITH_CELL_DAYS}, {WITH_POINTS}, p AS (SELECT fire_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN floor((x + 5e3 - 6e5) / 5e2) < 40 THEN CAST(floor((52e5 - y) / 5e2) * 40 + floor((x + 5e3 - 6e5) / 5e2) AS BIGINT) END AS cell_id "
    "FROM points JOIN orders ON o_orderkey = fire_id), q AS (SELECT quantile_cont(raw, [i / 1e3 FOR i IN range(0, 1001)]) AS v FROM cell_days) "
    f"SELECT fire_id, p.cell_id, raw AS probability, CAST({CLASS_SQL.format(v='raw')} AS TINYINT) AS danger_class, CASE WHEN raw IS NOT NULL THEN greatest(len(list_filter(v, lambda x: x <= raw)) - 1, 0) / 1e1 END AS record_percentile "
    "FROM p LEFT JOIN cell_days c ON c.cell_id = p.cell_id AND c.date = p.date, q",
)
def point_query(t: Tables):
    rows = scored(t)
    ladder = ordering.ladder(rows, (), "probability", 1001)
    days = t.orders.select(
        F.col("o_orderkey").alias("fire_id"), F.to_date("o_orderdate").alias("date")
    )
    asked = points(t).join(days, "fire_id").withColumn("x", F.col("x") + 5000.0)
    grid = spec(t)
    out = mq.query_points(asked.select("fire_id", "x", "y", "date"), rows, grid, BREAKS, ladder)
    return out.select("fire_id", "cell_id", "probability", "danger_class", "record_percentile")


@query(
    "j03_events_on_days",
    "SELECT o_orderkey AS fire_id, CAST(o_orderdate AS DATE) AS date, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[' || o_custkey || ',0],[' || o_custkey || ',' || o_orderkey || ']]]},\"properties\":{\"cause\":' || (o_orderkey % 12) || '}}' AS feature "
    "FROM orders WHERE month(o_orderdate) = 8",
)
def events_on_days(t: Tables):
    zero = F.lit(0).cast("bigint")
    ring = F.array(
        F.struct(F.col("cell_id").alias("x"), zero.alias("y")),
        F.struct(F.col("cell_id").alias("x"), F.col("fire_id").alias("y")),
    )
    events = t.fires().select(
        "fire_id", F.col("ignition_date").alias("date"), "cause", ring.alias("vertices")
    )
    days = events.where(F.month("date") == 8).select("date").distinct()
    return mq.events_on(events, days, ["cause"])


@query(
    "j04_freshness",
    "SELECT 'orders' AS source, CAST(max(o_orderdate) AS DATE) AS last_date, count(o_orderdate) AS rows FROM orders UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE), count(l_shipdate) FROM lineitem "
    "UNION ALL SELECT 'events', CAST(max(ts) AS DATE), count(ts) FROM events",
)
def freshness(t: Tables):
    return mq.freshness(
        {
            "orders": (t.orders, "o_orderdate"),
            "lineitem": (t.lineitem, "l_shipdate"),
            "events": (t.events, "ts"),
        }
    )


@query(
    "j05_record_counts",
    f"WITH {WITH_FIRES} SELECT count(*) FILTER (year BETWEEN 1996 AND 1999) AS in_record, count(*) FILTER (year > 1999) AS after_record, count(*) AS \"all\" FROM fires",
)
def record_counts(t: Tables):
    return mq.record_counts(t.fires(), 1996, 1999)


@query(
    "j05_source_catalogue",
    "SELECT l_linestatus AS category, count(DISTINCT l_returnflag) AS columns, count(DISTINCT l_returnflag) FILTER (l_returnflag = 'R') AS dynamic FROM lineitem GROUP BY 1",
)
def source_catalogue(t: Tables):
    pairs = t.lineitem.select("l_linestatus", "l_returnflag").distinct()
    registry = pairs.select(
        F.col("l_linestatus").alias("category"),
        F.when(F.col("l_returnflag") == "R", "dynamic").otherwise("static").alias("temporal"),
    )
    return mq.source_catalogue(registry)


@query(
    "j06_days_to_compute",
    f"WITH {WITH_CELL_DAYS} SELECT date FROM (SELECT CAST(unnest(generate_series(DATE '2001-11-01' - 30, DATE '2001-11-01' + 10, INTERVAL 1 DAY)) AS DATE) AS date) WHERE date NOT IN (SELECT date FROM cell_days)",
)
def days_to_compute(t: Tables):
    return mq.days_to_compute(t.cell_days(), F.lit("2001-11-01").cast("date"))


@query(
    "j07_extent",
    f"WITH {WITH_GRID} SELECT c_nationkey AS area, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM grid GROUP BY 1",
)
def extent(t: Tables):
    return mq.extent(t.grid().withColumnRenamed("c_nationkey", "area"), ["area"])


@query(
    "i29_scored_days",
    f"WITH {WITH_CELL_DAYS}, m AS (SELECT *, CASE WHEN raw < 5e-2 THEN 1e-2 WHEN raw < 5e-1 THEN 1e-2 + 39e-2 / 45e-2 * (raw - 5e-2) WHEN raw < 9e-1 THEN 4e-1 + 45e-2 / 4e-1 * (raw - 5e-1) ELSE 85e-2 END AS s FROM cell_days) "
    "SELECT cell_id, date, raw, round(1e0 / (1e0 + exp(-(ln(s / (1e0 - s)) - 6e0 + 3e-1))), 12) AS probability, round((rank() OVER (PARTITION BY date ORDER BY raw) + (count(*) OVER (PARTITION BY date, raw) - 1) / 2e0) / count(*) OVER (PARTITION BY date), 9) AS rank FROM m",
)
def scored_days(t: Tables):
    from gridrisk.functions.lookup import knots
    from gridrisk.plans.scoring import score_days

    points_ = knots((0.05, 0.5, 0.9), (0.01, 0.4, 0.85))
    out = score_days(t.cell_days(), F.col("raw"), points_, -6.0, 0.3)
    return out.select(
        "cell_id",
        "date",
        "raw",
        F.round("probability", 12).alias("probability"),
        F.round("rank", 9).alias("rank"),
    )


@query(
    "i30_scored_cases",
    f"WITH {WITH_CELL_DAYS}, {WITH_FIRES}, r AS (SELECT cell_id, date, raw, (rank() OVER (PARTITION BY date ORDER BY raw) + (count(*) OVER (PARTITION BY date, raw) - 1) / 2e0) / count(*) OVER (PARTITION BY date) AS pct FROM cell_days), "
    "h AS (SELECT cell_id, sum(raw) AS d FROM cell_days GROUP BY 1), b AS (SELECT cell_id, (rank() OVER (ORDER BY round(d, 6)) + (count(*) OVER (PARTITION BY round(d, 6)) - 1) / 2e0) / count(*) OVER () AS baseline FROM h), "
    "c AS (SELECT fire_id AS case_id, f.cell_id, ignition_date AS date, raw, pct FROM fires f JOIN r ON r.cell_id = f.cell_id AND r.date = f.ignition_date), "
    "n AS (SELECT case_id, max(r.pct) AS percentile_max, count(*) AS cells_in_radius FROM c JOIN r ON r.date = c.date AND abs(r.cell_id - c.cell_id) <= 2 GROUP BY 1), "
    "m AS (SELECT case_id, max(b.baseline) AS baseline_max FROM c JOIN b ON abs(b.cell_id - c.cell_id) <= 2 GROUP BY 1) "
    f"SELECT case_id, round(pct, 9) AS percentile, round(percentile_max, 9) AS percentile_max, cells_in_radius, CAST({CLASS_SQL.format(v='raw')} AS TINYINT) AS danger_class, round(baseline, 9) AS baseline, round(baseline_max, 9) AS baseline_max, "
    "round(1e0 / (nullif(raw, 0) * 365.25e0), 8) AS return_period_years FROM c JOIN n USING (case_id) JOIN m USING (case_id) JOIN b USING (cell_id)",
)
def scored_cases(t: Tables):
    from gridrisk.functions.lookup import classify
    from gridrisk.plans.verification import history_baseline, score_cases, temporal_percentile

    rows = t.cell_days().select("cell_id", "date", "raw")
    cases = t.fires().select(
        F.col("fire_id").alias("case_id"), "cell_id", F.col("ignition_date").alias("date")
    )
    ranked = ordering.percentile_rank(rows, ["date"], "raw", "percentile").withColumnRenamed(
        "raw", "probability"
    )
    density = rows.groupBy("cell_id").agg(F.round(F.sum("raw"), 6).alias("d"))
    baseline = history_baseline(density, "d").drop("d")
    around = F.explode(F.sequence(F.col("cell_id") - 2, F.col("cell_id") + 2)).alias("cell_id")
    near = cases.select("case_id", around)
    temporal = temporal_percentile(
        cases.withColumnRenamed("date", "event_date"), rows, 15, event="case_id"
    )
    classes = classify(F.col("probability"), BREAKS)
    out = score_cases(cases, ranked, temporal, baseline, near, classes)
    return out.select(
        "case_id",
        *(F.round(c, 9).alias(c) for c in ("percentile", "percentile_max")),
        "cells_in_radius",
        "danger_class",
        *(F.round(c, 9).alias(c) for c in ("baseline", "baseline_max")),
        F.round("return_period_years", 8).alias("return_period_years"),
    )
