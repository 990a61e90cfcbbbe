"""Section D: joins of stated arity, as-of joins, interpolation and source planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk.catalog.aggregates import EXCLUSION_SQL, exclusion_inputs
from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import (
    WITH_CELL_DAYS,
    WITH_DAILY,
    WITH_FIRES,
    WITH_GRID,
    WITH_HOURLY,
    Tables,
)
from gridrisk.catalog.windows import COMPOSITES_SQL, composites
from gridrisk.operators import climate, events as ev, joins as jn, provenance as pv
from gridrisk.operators import windows as w
from gridrisk.plans.training import Blocks, assemble


@query(
    "d01_many_to_one",
    f"WITH {WITH_FIRES}, {WITH_GRID} SELECT fire_id, f.cell_id, elevation, is_active FROM fires f LEFT JOIN grid g ON g.cell_id = f.cell_id + 20",
)
def many_to_one(t: Tables):
    dims = t.grid().select((F.col("cell_id") - 20).alias("cell_id"), "elevation", "is_active")
    return jn.join_to_one(t.fires().select("fire_id", "cell_id"), dims, ["cell_id"])


@query(
    "d02_one_to_one",
    f"WITH {WITH_DAILY} SELECT a.era5_id, a.date, a.temp_mean, b.precip_sum FROM daily a JOIN daily b ON a.era5_id = b.era5_id AND a.date = b.date",
)
def one_to_one(t: Tables):
    days = t.daily()
    return jn.join_one_to_one(
        days.select("era5_id", "date", "temp_mean"),
        days.select("era5_id", "date", "precip_sum"),
        ["era5_id", "date"],
    )


EDITIONS = (1994, 1996, 2000)
EDITION_SQL = "CASE WHEN year <= 1995 THEN 1994 WHEN year <= 1998 THEN 1996 ELSE 2000 END"


@query(
    "d03_nearest_edition",
    f"WITH {WITH_FIRES}, e AS (SELECT o_custkey AS cell_id, 1994 AS ed, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 1996, sum(o_orderkey % 5)::BIGINT FROM orders GROUP BY 1 "
    f"UNION ALL SELECT o_custkey, 2000, sum(o_orderkey % 7)::BIGINT FROM orders GROUP BY 1) SELECT fire_id, f.cell_id, CAST({EDITION_SQL} AS SMALLINT) AS clc_edition, n AS share "
    f"FROM fires f LEFT JOIN e ON e.cell_id = f.cell_id AND e.ed = {EDITION_SQL}",
)
def nearest_edition(t: Tables):
    per_cell = t.orders.groupBy(F.col("o_custkey").alias("cell_id")).agg(
        F.count("*").alias("a"),
        F.sum(F.col("o_orderkey") % 5).alias("b"),
        F.sum(F.col("o_orderkey") % 7).alias("c"),
    )
    blocks = F.array(
        *(
            F.struct(F.lit(year).cast("smallint").alias("clc_edition"), F.col(c).alias("share"))
            for year, c in zip(EDITIONS, ("a", "b", "c"))
        )
    )
    editions = per_cell.select("cell_id", F.explode(blocks).alias("e")).select("cell_id", "e.*")
    left = t.fires().select("fire_id", "cell_id", "year")
    return jn.edition_join(
        left, editions, ["cell_id"], "clc_edition", F.col("year"), EDITIONS
    ).drop("year")


@query(
    "d04_preceding_composite",
    f"WITH {WITH_FIRES}, {COMPOSITES_SQL}, m AS (SELECT DISTINCT month FROM composites WHERE year(month) <> 1997), "
    "f AS (SELECT fire_id, cell_id % 60 AS cell_id, CAST(date_trunc('month', ignition_date) AS DATE) AS own FROM fires), "
    "p AS (SELECT f.*, (SELECT max(month) FROM m WHERE m.month < f.own) AS composite_month FROM f) "
    "SELECT fire_id, p.cell_id, composite_month, ndvi FROM p LEFT JOIN composites c ON c.cell_id = p.cell_id AND c.month = p.composite_month",
)
def preceding_composite(t: Tables):
    left = t.fires().select("fire_id", (F.col("cell_id") % 60).alias("cell_id"), "ignition_date")
    # a year without composites, so that some rows have to reach further back
    known = composites(t).where(F.year("month") != 1997).select("cell_id", "month", "ndvi")
    return jn.preceding_join(left, known, ["cell_id"], "ignition_date", "month").select(
        "fire_id", "cell_id", "composite_month", "ndvi"
    )


@query(
    "d05_clamped_key",
    f"WITH {WITH_FIRES}, h AS (SELECT cell_id, year, count(*) AS n FROM fires WHERE year <= 1998 GROUP BY 1, 2) SELECT fire_id, f.cell_id, least(f.year, 1998) AS history_year, n "
    "FROM fires f LEFT JOIN h ON h.cell_id = f.cell_id AND h.year = least(f.year, 1998)",
)
def clamped_key(t: Tables):
    fires = t.fires().select("fire_id", "cell_id", F.col("year").cast("bigint").alias("year"))
    history = (
        fires.where("year <= 1998")
        .groupBy("cell_id", F.col("year").alias("history_year"))
        .agg(F.count("*").alias("n"))
    )
    return jn.clamped_join(fires, history, ["cell_id"], F.col("year"), "history_year").drop("year")


WEIGHTS_SQL = (
    "weights AS (SELECT c_custkey AS cell_id, unnest([c_custkey % 8, (c_custkey + 1) % 8, (c_custkey + 2) % 8, (c_custkey + 3) % 8]) AS era5_id, "
    "unnest([4e-1, 3e-1, 2e-1, 1e-1]) AS weight FROM customer)"
)


def weights(t: Tables):
    nodes = [(F.col("c_custkey") + i) % 8 for i in range(4)]
    pairs = F.array(
        *(
            F.struct(n.alias("era5_id"), F.lit(v).alias("weight"))
            for n, v in zip(nodes, (0.4, 0.3, 0.2, 0.1))
        )
    )
    return t.customer.select(F.col("c_custkey").alias("cell_id"), F.explode(pairs).alias("p")).select(
        "cell_id", "p.*"
    )


INTERPOLATE = (
    f"WITH {WITH_FIRES}, {WITH_DAILY}, {WEIGHTS_SQL}, j AS (SELECT f.fire_id, weight, temp_mean, wind_speed_max FROM fires f JOIN weights w ON w.cell_id = f.cell_id "
    "LEFT JOIN daily d ON d.era5_id = w.era5_id AND d.date = f.ignition_date) "
)


@query(
    "d06_interpolation",
    INTERPOLATE + "SELECT fire_id, round(CASE WHEN bool_and(temp_mean IS NOT NULL AND wind_speed_max IS NOT NULL) THEN CAST(sum(weight * temp_mean) AS FLOAT) END::DOUBLE, 3) AS temp_mean, "
    "round(CASE WHEN bool_and(temp_mean IS NOT NULL AND wind_speed_max IS NOT NULL) THEN CAST(sum(weight * wind_speed_max) AS FLOAT) END::DOUBLE, 3) AS wind_speed_max FROM j GROUP BY fire_id",
)
def interpolation(t: Tables):
    samples = t.fires().select("fire_id", "cell_id", F.col("ignition_date").alias("date"))
    columns = ["temp_mean", "wind_speed_max"]
    out = jn.interpolate(samples, weights(t), t.daily(), columns, ["fire_id"])
    return out.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in columns})


@query(
    "d07_partial_interpolation",
    INTERPOLATE + "SELECT fire_id, round(sum(weight * temp_mean), 10) AS temp_mean, round(coalesce(sum(weight * wind_speed_max), 0e0), 10) AS wind_speed_max FROM j GROUP BY fire_id",
)
def partial_interpolation(t: Tables):
    samples = t.fires().select("fire_id", "cell_id", F.col("ignition_date").alias("date"))
    args = (samples, weights(t), t.daily())
    kept = jn.interpolate_partial(*args, ["temp_mean"], ["fire_id"])
    filled = jn.interpolate_partial(*args, ["wind_speed_max"], ["fire_id"], fill=0.0)
    return kept.join(filled, "fire_id").withColumns(
        {c: F.round(c, 10) for c in ("temp_mean", "wind_speed_max")}
    )


@query(
    "d08_heaviest_neighbour",
    "WITH w AS (SELECT l_orderkey AS cell_id, l_suppkey AS era5_id, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY weight DESC, era5_id) AS k FROM w) SELECT cell_id, era5_id FROM r WHERE k = 1",
)
def heaviest_neighbour(t: Tables):
    rows = t.lineitem.groupBy(
        F.col("l_orderkey").alias("cell_id"), F.col("l_suppkey").alias("era5_id")
    ).agg(F.sum("l_quantity").alias("weight"))
    return jn.heaviest_neighbour(rows)


@query(
    "d09_active_cells_only",
    f"WITH {WITH_FIRES}, {WITH_GRID} SELECT fire_id, cell_id FROM fires WHERE cell_id IN (SELECT cell_id FROM grid WHERE is_active)",
)
def active_cells_only(t: Tables):
    active = t.grid().where("is_active").select("cell_id")
    return t.fires().select("fire_id", "cell_id").join(active, "cell_id", "left_semi")


@query(
    "d10_outside_exclusions",
    f"WITH {EXCLUSION_SQL}, c AS (SELECT o_custkey AS cell_id, CAST(o_orderdate AS DATE) + 5 AS date FROM orders) "
    "SELECT cell_id, date FROM c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.cell_id = c.cell_id AND p.date = c.date)",
)
def outside_exclusions(t: Tables):
    _, pairs = exclusion_inputs(t)
    candidates = t.orders.select(
        F.col("o_custkey").alias("cell_id"),
        F.date_add(F.to_date("o_orderdate"), 5).alias("date"),
    )
    return candidates.join(ev.unique_exclusions(pairs), ["cell_id", "date"], "left_anti")


@query(
    "d11_event_cell_days",
    f"WITH {EXCLUSION_SQL} SELECT fire_id, cell_id, date, CAST(level AS TINYINT) AS level FROM pairs",
)
def event_cell_days(t: Tables):
    _, pairs = exclusion_inputs(t)
    return pairs


@query(
    "d12_near_other_events",
    f"WITH {EXCLUSION_SQL}, pos AS (SELECT DISTINCT cell_id, ignition_date AS date FROM fires), hit AS (SELECT DISTINCT p.cell_id, p.date FROM pos p JOIN pairs x USING (cell_id, date) "
    "JOIN spans s ON s.fire_id = x.fire_id WHERE s.cell_id <> p.cell_id OR s.s <> p.date) SELECT pos.cell_id, pos.date, hit.cell_id IS NOT NULL AS is_near_fire "
    "FROM pos LEFT JOIN hit USING (cell_id, date)",
)
def near_other_events(t: Tables):
    events, pairs = exclusion_inputs(t)
    positives = t.fires().select("cell_id", F.col("ignition_date").alias("date")).distinct()
    return ev.near_other_events(positives, pairs, events)


@query(
    "d13_population_size",
    f"WITH {EXCLUSION_SQL}, {WITH_GRID}, a AS (SELECT cell_id FROM grid WHERE is_active), x AS (SELECT DISTINCT cell_id, date FROM pairs WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' "
    "AND cell_id IN (SELECT cell_id FROM a)) SELECT (SELECT count(*) FROM a) AS cells, CAST(2557 AS INT) AS days, (SELECT count(*) FROM x) AS excluded_cell_days, "
    "(SELECT count(*) FROM a) * 2557 - (SELECT count(*) FROM x) AS population_negatives",
)
def population_size(t: Tables):
    from gridrisk.operators.calibration import sampling_rate

    _, pairs = exclusion_inputs(t)
    active = t.grid().where("is_active")
    out = sampling_rate(active, pairs, "1995-01-01", "2001-12-31", t.fires())
    return out.select("cells", "days", "excluded_cell_days", "population_negatives")


@query(
    "d14_attribute_lookup",
    f"WITH {WITH_FIRES}, {WITH_GRID} SELECT fire_id, area_ha, cause, n_name, r_name FROM fires f JOIN grid g USING (cell_id) "
    "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def attribute_lookup(t: Tables):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    cells = t.grid().join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.fires().join(cells.select("cell_id", "n_name", "r_name"), "cell_id").select(
        "fire_id", "area_ha", "cause", "n_name", "r_name"
    )


@query(
    "d15_source_against_source",
    f"WITH {WITH_HOURLY}, a AS (SELECT cell_id, CAST(ts AS DATE) AS date, max(temp_c) AS temp_cached FROM hourly WHERE event_id % 2 = 0 GROUP BY 1, 2), "
    "b AS (SELECT cell_id, CAST(ts AS DATE) AS date, max(temp_c) AS temp_served FROM hourly WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT cell_id, date, temp_cached, temp_served FROM a JOIN b USING (cell_id, date)",
)
def source_against_source(t: Tables):
    def half(parity: int, name: str):
        rows = t.hourly().where(F.col("event_id") % 2 == parity)
        return rows.groupBy("cell_id", F.to_date("ts").alias("date")).agg(
            F.max("temp_c").alias(name)
        )

    return jn.join_one_to_one(
        half(0, "temp_cached"), half(1, "temp_served"), ["cell_id", "date"]
    )


@query(
    "d16_reindex",
    f"WITH {WITH_FIRES}, {WITH_GRID}, c AS (SELECT cell_id, count(*) AS n FROM fires GROUP BY 1) SELECT cell_id, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (cell_id)",
)
def reindex(t: Tables):
    counts = t.fires().groupBy("cell_id").agg(F.count("*").alias("n"))
    return jn.reindex(t.grid().select("cell_id"), counts, ["cell_id"], {"n": 0})


LADDER_SQL = (
    f"{WITH_DAILY}, ref AS (SELECT * FROM daily WHERE year(date) <= 1998), lad AS (SELECT era5_id, month(date) AS month, quantile_cont(wind_speed_mean, [i / 1e2 FOR i IN range(0, 101)]) AS cached, "
    "quantile_cont(wind_speed_max * 2e0, [i / 1e2 FOR i IN range(0, 101)]) AS served FROM ref GROUP BY 1, 2)"
)


@query(
    "d17_quantile_map",
    f"WITH {LADDER_SQL}, k AS (SELECT era5_id, month, unnest(range(0, 101)) AS i, unnest(served) AS x, unnest(cached) AS y FROM lad), "
    "k2 AS (SELECT *, lag(x) OVER (PARTITION BY era5_id, month ORDER BY i) AS before FROM k), k3 AS (SELECT era5_id, month, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, "
    "row_number() OVER w AS rn FROM k2 WHERE before IS NULL OR x > before WINDOW w AS (PARTITION BY era5_id, month ORDER BY i)), "
    "d AS (SELECT era5_id, date, wind_speed_max * 2e0 + (n_rows % 3) * 1e-2 AS v FROM daily) "
    "SELECT d.era5_id, d.date, round(CASE WHEN k3.x IS NULL THEN (SELECT min(y) FROM k3 z WHERE z.era5_id = d.era5_id AND z.month = month(d.date) AND z.rn = 1) WHEN x1 IS NULL THEN y "
    "ELSE y + (y1 - y) / (x1 - x) * (v - x) END, 9) AS wind_speed_max FROM d LEFT JOIN k3 ON k3.era5_id = d.era5_id AND k3.month = month(d.date) AND k3.x <= v AND (k3.x1 IS NULL OR v < k3.x1)",
)
def quantile_map(t: Tables):
    days = t.daily()
    reference = days.where(F.year("date") <= 1998)
    cached = climate.month_ladders(
        reference.select("era5_id", "date", F.col("wind_speed_mean").alias("wind_speed_max")),
        "era5_id",
        "date",
        ["wind_speed_max"],
    )
    served = climate.month_ladders(
        reference.select(
            "era5_id", "date", (F.col("wind_speed_max") * 2.0).alias("wind_speed_max")
        ),
        "era5_id",
        "date",
        ["wind_speed_max"],
    )
    knots = climate.paired_ladders(cached, served, "era5_id")
    remote = days.select(
        "era5_id",
        "date",
        (F.col("wind_speed_max") * 2.0 + F.col("n_rows") % 3 * F.lit(1e-2)).alias("wind_speed_max"),
    )
    mapped = climate.map_quantiles(remote, knots, "era5_id", "date", ["wind_speed_max"])
    return mapped.withColumn("wind_speed_max", F.round("wind_speed_max", 9))


@query(
    "d18_percentile_anomaly",
    f"WITH {LADDER_SQL}, k AS (SELECT era5_id, month, unnest(range(0, 101)) AS i, unnest(cached) AS x FROM lad), k2 AS (SELECT *, lag(x) OVER (PARTITION BY era5_id, month ORDER BY i) AS before FROM k), "
    "k3 AS (SELECT era5_id, month, x, i * 1e0 AS y, lead(x) OVER w AS x1, lead(i) OVER w * 1e0 AS y1 FROM k2 WHERE before IS NULL OR x > before WINDOW w AS (PARTITION BY era5_id, month ORDER BY i)) "
    "SELECT d.era5_id, d.date, round(CAST(CASE WHEN k3.x IS NULL THEN 0e0 WHEN x1 IS NULL THEN y ELSE y + (y1 - y) / (x1 - x) * (wind_speed_mean - x) END AS FLOAT)::DOUBLE, 2) AS wind_anom FROM daily d "
    "LEFT JOIN k3 ON k3.era5_id = d.era5_id AND k3.month = month(d.date) AND k3.x <= wind_speed_mean AND (k3.x1 IS NULL OR wind_speed_mean < k3.x1)",
)
def percentile_anomaly(t: Tables):
    days = t.daily().select("era5_id", "date", F.col("wind_speed_mean").alias("wind"))
    ladders = climate.month_ladders(
        days.where(F.year("date") <= 1998), "era5_id", "date", ["wind"]
    )
    knots = climate.anomaly_knots(ladders, "era5_id")
    out = climate.attach_anomalies(days, knots, "era5_id", "date", ["wind"])
    return out.select(
        "era5_id", "date", F.round(F.col("wind_anom").cast("double"), 2).alias("wind_anom")
    )


TRAINING_SQL = (
    f"WITH {WITH_FIRES}, {WITH_GRID}, {WITH_DAILY}, {COMPOSITES_SQL}, {WEIGHTS_SQL}, "
    "m AS (SELECT DISTINCT month FROM composites), s AS (SELECT fire_id AS sample_id, cell_id, ignition_date AS date FROM fires), "
    "i AS (SELECT sample_id, CASE WHEN bool_and(temp_mean IS NOT NULL AND rh_mean IS NOT NULL) THEN CAST(sum(weight * temp_mean) AS FLOAT) END AS temp_mean, "
    "CASE WHEN bool_and(temp_mean IS NOT NULL AND rh_mean IS NOT NULL) THEN CAST(sum(weight * rh_mean) AS FLOAT) END AS rh_mean "
    "FROM s JOIN weights w ON w.cell_id = s.cell_id LEFT JOIN daily d ON d.era5_id = w.era5_id AND d.date = s.date GROUP BY sample_id), "
    "p AS (SELECT s.*, (SELECT max(month) FROM m WHERE m.month < date_trunc('month', s.date)) AS veg_composite_date FROM s) "
    "SELECT p.sample_id, p.cell_id, p.date, round(g.elevation, 6) AS elevation, p.veg_composite_date, round(c.ndvi, 6) AS ndvi, round(i.temp_mean::DOUBLE, 3) AS temp_mean, "
    "round(i.rh_mean::DOUBLE, 3) AS rh_mean, x.precip_sum, CAST(month(p.date) AS TINYINT) AS month, CAST(isodow(p.date) - 1 AS TINYINT) AS day_of_week "
    "FROM p LEFT JOIN grid g USING (cell_id) LEFT JOIN composites c ON c.cell_id = p.cell_id AND c.month = p.veg_composite_date "
    "LEFT JOIN i USING (sample_id) LEFT JOIN daily x ON x.era5_id = p.cell_id % 8 AND x.date = p.date"
)


def training_blocks(t: Tables) -> Blocks:
    days = t.daily()
    return Blocks(
        static=[t.grid().select("cell_id", "elevation")],
        vegetation=composites(t).select("cell_id", "month", "ndvi"),
        weights=weights(t),
        backbone=days,
        backbone_columns=["temp_mean", "rh_mean"],
        indices=days.select("era5_id", "date", "precip_sum"),
    )


@query("d19_training_table", TRAINING_SQL)
def training_table(t: Tables):
    spine = t.fires().select(
        F.col("fire_id").alias("sample_id"), "cell_id", F.col("ignition_date").alias("date")
    )
    out = assemble(spine, training_blocks(t))
    return out.select(
        "sample_id",
        "cell_id",
        "date",
        F.round("elevation", 6).alias("elevation"),
        "veg_composite_date",
        F.round("ndvi", 6).alias("ndvi"),
        F.round(F.col("temp_mean").cast("double"), 3).alias("temp_mean"),
        F.round(F.col("rh_mean").cast("double"), 3).alias("rh_mean"),
        "precip_sum",
        "month",
        "day_of_week",
    )


@query(
    "d20_provider_plan",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), p AS (SELECT date, CASE WHEN date <= DATE '2001-01-08' THEN 'archive' "
    "WHEN date BETWEEN DATE '2000-10-15' AND DATE '2001-01-25' THEN 'forecast' ELSE 'none' END AS provider FROM d), "
    "g AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY provider ORDER BY date) AS INT) AS island FROM p) "
    "SELECT provider, min(date) AS start, max(date) AS \"end\", count(*) AS days FROM g GROUP BY provider, island",
)
def provider_plan(t: Tables):
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    today = F.lit("2001-01-15").cast("date")
    return pv.plan_segments(pv.provider_windows(days, today), [])


@query(
    "d21_stitched_series",
    "WITH h AS (SELECT user_id AS cell_id, date_trunc('hour', ts) AS ts, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS priority, value FROM events), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, ts ORDER BY priority, value) AS k FROM h), s AS (SELECT cell_id, ts, priority, value FROM r WHERE k = 1) "
    "SELECT cell_id, ts, priority, value, CAST(date_diff('hour', lag(ts) OVER (PARTITION BY cell_id ORDER BY ts), ts) AS BIGINT) AS step FROM s "
    "QUALIFY date_diff('hour', lag(ts) OVER (PARTITION BY cell_id ORDER BY ts), ts) <> 1",
)
def stitched_series(t: Tables):
    kind = F.col("event_type")
    hour = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("ts"))
    parts = t.events.select(
        F.col("user_id").alias("cell_id"),
        hour.alias("ts"),
        F.when(kind == "view", 1).when(kind == "click", 2).otherwise(3).alias("priority"),
        "value",
    )
    series = pv.stitch(parts, ["cell_id"], "ts", "priority")
    return pv.broken_steps(series, ["cell_id"], w.hour_number(F.col("ts")))


@query(
    "d22_superseded_days",
    f"WITH {WITH_CELL_DAYS}, {WITH_FIRES}, seg AS (SELECT cell_id AS run_id, ignition_date AS a, ignition_date + CAST(fire_id % 4 AS INT) AS b FROM fires WHERE cause >= 6) "
    "SELECT cell_id AS run_id, date, raw FROM cell_days c WHERE date <= DATE '2000-12-25' AND EXISTS (SELECT 1 FROM seg WHERE run_id = c.cell_id AND c.date BETWEEN a AND b)",
)
def superseded_days(t: Tables):
    segments = t.fires().select(
        F.col("cell_id").alias("run_id"),
        F.when(F.col("cause") >= 6, "forecast").otherwise("archive").alias("provider"),
        F.col("ignition_date").alias("start"),
        F.date_add("ignition_date", (F.col("fire_id") % 4).cast("int")).alias("end"),
    )
    scored = t.cell_days().select(F.col("cell_id").alias("run_id"), "date", "raw")
    return pv.superseded_days(scored, segments, F.lit("2001-01-01").cast("date"))


@query(
    "d23_runs",
    f"WITH {WITH_CELL_DAYS}, b AS (SELECT cell_id, date, date <= DATE '1999-12-31' AS cached FROM cell_days), g AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY cell_id, cached ORDER BY date) AS INT) AS island FROM b) "
    "SELECT cell_id, min(date) AS start, max(date) AS \"end\", count(*) AS days FROM g GROUP BY cell_id, cached, island",
)
def day_runs(t: Tables):
    days = t.cell_days().select("cell_id", "date")
    return pv.runs(days, ["cell_id"], "date", F.col("date") <= F.lit("1999-12-31").cast("date"))


@query(
    "d24_table_equivalence",
    f"WITH {WITH_DAILY}, b AS (SELECT era5_id, date, CASE WHEN n_rows % 10 = 0 THEN wind_speed_max + 1 ELSE wind_speed_max END AS v FROM daily), a AS (SELECT era5_id, date, wind_speed_max AS v FROM daily) "
    "SELECT era5_id, date, v, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT era5_id, date, v, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
)
def table_equivalence(t: Tables):
    days = t.daily()
    top = F.col("wind_speed_max")
    changed = F.when(F.col("n_rows") % 10 == 0, top + 1).otherwise(top)
    return jn.table_differences(
        days.select("era5_id", "date", top.alias("v")),
        days.select("era5_id", "date", changed.alias("v")),
    )


@query(
    "d24_column_mismatches",
    f"WITH {WITH_DAILY} SELECT 'temp_mean' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM daily UNION ALL SELECT 'wind_speed_max', count(*), count(*) FILTER (n_rows % 10 = 0) FROM daily",
)
def column_mismatches(t: Tables):
    days = t.daily()
    top = F.col("wind_speed_max")
    changed = days.withColumn(
        "wind_speed_max", F.when(F.col("n_rows") % 10 == 0, top + 1).otherwise(top)
    )
    return jn.column_mismatches(
        days, changed, ["era5_id", "date"], ["temp_mean", "wind_speed_max"], 1e-9
    )


@query(
    "d25_reproducibility",
    f"WITH {WITH_CELL_DAYS}, s AS (SELECT cell_id, avg(raw) AS v FROM cell_days GROUP BY cell_id), r AS (SELECT cell_id, CASE WHEN cell_id % 20 = 0 THEN v + 1e-5 ELSE v END AS w FROM s) "
    "SELECT cell_id, round(w - v, 9) AS gap FROM s JOIN r USING (cell_id) WHERE abs(w - v) > 1e-6",
)
def reproducibility(t: Tables):
    from gridrisk.operators.evaluation import not_reproduced

    stored = t.cell_days().groupBy("cell_id").agg(F.avg("raw").alias("value"))
    again = stored.withColumn(
        "value",
        F.when(F.col("cell_id") % 20 == 0, F.col("value") + 1e-5).otherwise(F.col("value")),
    )
    out = not_reproduced(stored, again, ["cell_id"], "value", 1e-6)
    return out.select("cell_id", F.round("gap", 9).alias("gap"))


@query(
    "d26_event_preparation",
    f"WITH {WITH_FIRES}, p AS (SELECT *, greatest(coalesce(end_date_raw, ignition_date), ignition_date) - ignition_date AS days FROM fires WHERE cause <> 11) "
    "SELECT (SELECT count(*) FROM fires) AS events, count(*) AS dated, median(days) AS median_days, round(avg(days), 6) AS mean_days, CAST(max(days) AS INT) AS max_days FROM p",
)
def event_preparation(t: Tables):
    fires = t.fires()
    undated = fires.withColumn(
        "ignition_date", F.when(F.col("cause") != 11, F.col("ignition_date"))
    )
    prepared = ev.prepare_events(undated, F.col("cell_id"))
    return ev.span_summary(prepared, undated).withColumn("mean_days", F.round("mean_days", 6))


@query(
    "d27_year_blocks",
    f"WITH {WITH_DAILY}, f AS (SELECT era5_id, min(date) AS first FROM daily GROUP BY 1) SELECT era5_id, CAST(year(date) AS INT) AS year, count(*) AS days FROM daily JOIN f USING (era5_id) WHERE date > first GROUP BY 1, 2",
)
def year_blocks(t: Tables):
    kept = pv.drop_first_day(t.daily(), ["era5_id"], "date")
    return kept.groupBy("era5_id", F.year("date").alias("year")).agg(F.count("*").alias("days"))


@query(
    "d27_missing_years",
    f"WITH {WITH_DAILY} SELECT CAST(y AS INT) AS year FROM range(1990, 2006) r(y) WHERE y NOT IN (SELECT year(date) FROM daily)",
)
def missing_years(t: Tables):
    return pv.missing_years(t.daily(), "date", 1990, 2005)


@query(
    "d28_monthly_source_check",
    f"WITH {WITH_CELL_DAYS}, {COMPOSITES_SQL}, m AS (SELECT cell_id, CAST(date_trunc('month', date) AS DATE) AS month, avg(raw) AS cover, count(*) AS days FROM cell_days GROUP BY 1, 2) "
    "SELECT m.cell_id, m.month, round(cover, 9) AS cover, days, ndvi FROM m JOIN composites c USING (cell_id, month) WHERE valid_fraction >= 2e-1",
)
def monthly_source_check(t: Tables):
    monthly = t.cell_days().groupBy(
        "cell_id", F.to_date(F.trunc("date", "month")).alias("month")
    ).agg(F.round(F.avg("raw"), 9).alias("cover"), F.count("*").alias("days"))
    usable = composites(t).where(F.col("valid_fraction") >= 0.2)
    return monthly.join(usable, ["cell_id", "month"]).select(
        "cell_id", "month", "cover", "days", "ndvi"
    )
