"""Section F: trailing windows, ranks and the fire-weather recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import (
    WITH_CELL_DAYS,
    WITH_DAILY,
    WITH_FIRES,
    WITH_HOURLY,
    Tables,
)
from gridrisk.operators import fire_weather
from gridrisk.operators import ordering
from gridrisk.operators import windows as w
from gridrisk.operators.daily import local_time

CELL = ("era5_id",)
FRAME = "PARTITION BY era5_id ORDER BY date RANGE BETWEEN INTERVAL {back} DAY PRECEDING AND {to}"


def _frame(back: int, to: str = "CURRENT ROW") -> str:
    return FRAME.format(back=back, to=to)


@query(
    "f01_trailing_windows",
    f"WITH {WITH_DAILY} SELECT era5_id, date, "
    + ", ".join(
        f"CASE WHEN count(precip_sum) OVER ({_frame(n - 1)}) = {n} THEN sum(precip_sum) OVER ({_frame(n - 1)}) END"
        f" AS precip_cum{n}"
        for n in (7, 15, 30)
    )
    + f", round(CASE WHEN count(temp_mean) OVER ({_frame(6)}) = 7 THEN sum(temp_mean) OVER ({_frame(6)}) END / 7, 6)"
    " AS temp_mean_7d FROM daily",
)
def trailing_windows(t: Tables):
    return t.daily().select(
        "era5_id",
        "date",
        *(w.trailing_sum(CELL, "date", "precip_sum", n).alias(f"precip_cum{n}") for n in (7, 15, 30)),
        F.round(w.trailing_mean(CELL, "date", "temp_mean", 7), 6).alias("temp_mean_7d"),
    )


@query(
    "f02_preceding_maximum",
    f"WITH {WITH_DAILY} SELECT era5_id, date, CASE WHEN count(wind_speed_max) OVER "
    f"({_frame(3, 'INTERVAL 1 DAY PRECEDING')}) = 3 THEN max(wind_speed_max) OVER "
    f"({_frame(3, 'INTERVAL 1 DAY PRECEDING')}) END AS wind_lag FROM daily",
)
def preceding_maximum(t: Tables):
    return t.daily().select(
        "era5_id", "date", w.preceding_max(CELL, "date", "wind_speed_max", 3).alias("wind_lag")
    )


@query(
    "f03_days_since",
    f"WITH {WITH_DAILY}, d AS (SELECT era5_id, date, max(CASE WHEN precip_sum >= 250 THEN date END) OVER "
    "(PARTITION BY era5_id ORDER BY date) AS wet, min(date) OVER (PARTITION BY era5_id) AS first FROM daily) "
    "SELECT era5_id, date, CAST(CASE WHEN wet IS NOT NULL THEN least(date_diff('day', wet, date), 60) "
    "WHEN date_diff('day', first, date) + 1 >= 60 THEN 60 END AS DOUBLE) AS days_since_rain FROM d",
)
def days_since(t: Tables):
    return t.daily().select(
        "era5_id",
        "date",
        w.days_since(CELL, "date", "precip_sum", 250.0, 60).alias("days_since_rain"),
    )


HOURS_SQL = (
    f"WITH {WITH_HOURLY}, h AS (SELECT cell_id % 8 AS cell_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS local_ts, "
    "sum(precip_mm) AS precip_mm FROM hourly GROUP BY 1, 2)"
)


def _cell_hours(t: Tables):
    local = local_time("ts")
    whole = F.to_date(local).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(local))
    hourly = t.hourly().withColumn("cell_id", F.col("cell_id") % 8)
    return w.one_row_per(
        hourly.withColumn("local_ts", whole),
        ["cell_id", "local_ts"],
        F.sum("precip_mm").alias("precip_mm"),
    )


@query(
    "f04_noon_accumulation",
    HOURS_SQL + ", s AS (SELECT cell_id, local_ts, count(*) OVER f AS n, sum(precip_mm) OVER f AS total FROM h "
    "WINDOW f AS (PARTITION BY cell_id ORDER BY local_ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)) "
    "SELECT cell_id, CAST(local_ts AS DATE) AS date, CASE WHEN n = 24 THEN total END AS precip_noon24 FROM s "
    "WHERE hour(local_ts) = 12",
)
def noon_accumulation(t: Tables):
    total = w.sum_to_hour(["cell_id"], "local_ts", "precip_mm", 24)
    return (
        _cell_hours(t)
        .withColumn("precip_noon24", total)
        .where(F.hour("local_ts") == 12)
        .select("cell_id", F.to_date("local_ts").alias("date"), "precip_noon24")
    )


@query(
    "f05_deaccumulate",
    HOURS_SQL + ", a AS (SELECT cell_id, local_ts, precip_mm % 7 + hour(local_ts) AS total FROM h), "
    "s AS (SELECT *, lag(total) OVER (PARTITION BY cell_id ORDER BY local_ts) AS before FROM a) "
    "SELECT cell_id, local_ts, CASE WHEN hour(local_ts) = 1 THEN greatest(total, 0e0) WHEN before IS NOT NULL "
    "THEN greatest(total - before, 0e0) END AS amount FROM s",
)
def deaccumulate(t: Tables):
    running = _cell_hours(t).withColumn("total", F.col("precip_mm") % 7 + F.hour("local_ts"))
    return running.select(
        "cell_id", "local_ts", w.deaccumulate(["cell_id"], "local_ts", "total").alias("amount")
    )


COMPOSITES_SQL = (
    "composites AS (SELECT o_custkey % 60 AS cell_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, "
    "max(o_totalprice) / 5e5 AS ndvi, CASE WHEN min(o_orderkey) % 3 > 0 THEN min(o_totalprice) / 5e5 END AS nbr, "
    "count(*) FILTER (o_orderstatus <> 'P') * 1e0 / count(*) * (min(o_orderkey) % 2) AS valid_fraction "
    "FROM orders GROUP BY 1, 2)"
)


def composites(t: Tables):
    """Orders as monthly composites of sixty cells, about half of them too cloudy."""
    return t.orders.groupBy(
        (F.col("o_custkey") % 60).alias("cell_id"),
        F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("month"),
    ).agg(
        (F.max("o_totalprice") / F.lit(5e5)).alias("ndvi"),
        F.when(F.min("o_orderkey") % 3 > 0, F.min("o_totalprice") / F.lit(5e5)).alias("nbr"),
        (
            F.count_if(F.col("o_orderstatus") != "P") / F.count("*") * (F.min("o_orderkey") % 2)
        ).alias("valid_fraction"),
    )


FILL_SQL = (
    "filled AS (SELECT c.cell_id, c.month, s.ndvi, s.nbr, CAST(date_diff('day', s.month, c.month) AS FLOAT) "
    "AS age_days FROM {left} c ASOF LEFT JOIN (SELECT * FROM composites WHERE valid_fraction >= 2e-1) s "
    "ON c.cell_id = s.cell_id AND c.month >= s.month) "
)


@query(
    "f06_capped_forward_fill",
    f"WITH {COMPOSITES_SQL}, " + FILL_SQL.format(left="composites") + "SELECT cell_id, month, "
    "CASE WHEN age_days <= 120 THEN ndvi END AS ndvi, CASE WHEN age_days <= 120 THEN nbr END AS nbr, "
    "CASE WHEN age_days <= 120 THEN age_days END AS age_days FROM filled",
)
def capped_forward_fill(t: Tables):
    filled = w.carry_forward(
        composites(t),
        ["cell_id"],
        "month",
        ["ndvi", "nbr"],
        F.col("valid_fraction") >= 0.2,
        120,
    )
    return filled.select("cell_id", "month", "ndvi", "nbr", "age_days")


@query(
    "f07_percentile_rank",
    f"WITH {WITH_CELL_DAYS} SELECT cell_id, date, round((rank() OVER (PARTITION BY date ORDER BY raw) + "
    "(count(*) OVER (PARTITION BY date, raw) - 1) / 2e0) / count(*) OVER (PARTITION BY date), 9) AS pct FROM cell_days",
)
def percentile_rank(t: Tables):
    ranked = ordering.percentile_rank(t.cell_days(), ["date"], "raw", "pct")
    return ranked.select("cell_id", "date", F.round("pct", 9).alias("pct"))


@query(
    "f08_temporal_rank",
    f"WITH {WITH_CELL_DAYS}, {WITH_FIRES}, e AS (SELECT fire_id, cell_id, ignition_date AS event_date FROM fires), "
    "s AS (SELECT fire_id, event_date, d.date, d.raw FROM e JOIN cell_days d ON d.cell_id = e.cell_id AND d.date "
    "BETWEEN e.event_date - 15 AND e.event_date + 15), r AS (SELECT *, (rank() OVER (PARTITION BY fire_id ORDER BY raw) + "
    "(count(*) OVER (PARTITION BY fire_id, raw) - 1) / 2e0) / count(*) OVER (PARTITION BY fire_id) AS pct, "
    "count(*) OVER (PARTITION BY fire_id) AS window_days FROM s) "
    "SELECT fire_id, window_days, round(pct, 9) AS temporal_percentile FROM r WHERE date = event_date",
)
def temporal_rank(t: Tables):
    from gridrisk.plans.verification import temporal_percentile

    events = t.fires().select("fire_id", "cell_id", F.col("ignition_date").alias("event_date"))
    out = temporal_percentile(events, t.cell_days().select("cell_id", "date", "raw"), 15)
    return out.select(
        "fire_id", "window_days", F.round("temporal_percentile", 9).alias("temporal_percentile")
    )


@query(
    "f09_gaps",
    f"WITH {WITH_DAILY}, g AS (SELECT era5_id, date, date_diff('day', lag(date) OVER (PARTITION BY era5_id "
    "ORDER BY date), date) - 1 AS missing FROM daily) SELECT era5_id, date, CAST(missing AS INT) AS missing "
    "FROM g WHERE missing > 0",
)
def gaps(t: Tables):
    return (
        t.daily()
        .select("era5_id", "date", w.gap_before(CELL, "date").alias("missing"))
        .where(F.col("missing") > 0)
    )


@query(
    "f10_running_maximum",
    "WITH s AS (SELECT l_extendedprice AS p, max(l_quantity) AS v FROM lineitem GROUP BY 1) "
    "SELECT p, max(v) OVER (ORDER BY p) AS top FROM s",
)
def running_maximum(t: Tables):
    points = t.lineitem.groupBy(F.col("l_extendedprice").alias("p")).agg(
        F.max("l_quantity").alias("v")
    )
    return ordering.running_max(points, (), "p", "v", "top").select("p", "top")


@query(
    "f11_latest_block",
    f"WITH {COMPOSITES_SQL}, inside AS (SELECT * FROM composites WHERE month BETWEEN DATE '2000-02-01' AND "
    "DATE '2000-06-01'), "
    + FILL_SQL.format(left="inside").replace("FROM composites WHERE", "FROM inside WHERE")
    + "SELECT cell_id, month, CASE WHEN age_days <= 120 THEN ndvi END AS ndvi, CASE WHEN age_days <= 120 THEN "
    "age_days END AS age_days FROM filled WHERE month = (SELECT max(month) FROM inside)",
)
def latest_block(t: Tables):
    block = w.latest_within(
        composites(t),
        ["cell_id"],
        "month",
        F.lit("2000-06-01").cast("date"),
        ["ndvi", "nbr"],
        F.col("valid_fraction") >= 0.2,
        120,
    )
    return block.select("cell_id", "month", "ndvi", "age_days")


NOON_SQL = (
    f"{WITH_DAILY}, noon AS (SELECT era5_id, date, temp_mean - 5e0 AS temp_noon, least(rh_mean * 18e-1, 1e2) AS rh_noon, "
    "wind_speed_mean * 3e0 AS wind_noon, greatest(precip_sum - 15e1, 0e0) / 1e1 AS rain_noon, "
    "row_number() OVER (PARTITION BY era5_id ORDER BY date) AS rn FROM daily)"
)

DRY_SQL = "(0.942e0 * pow(h, 0.679e0) + 11e0 * exp((h - 100e0) / 10e0) + tail)"
WET_SQL = "(0.618e0 * pow(h, 0.753e0) + 10e0 * exp((h - 100e0) / 10e0) + tail)"

FWI_SQL = f"""WITH RECURSIVE {NOON_SQL},
codes AS (
  SELECT era5_id, CAST(0 AS BIGINT) AS rn, DATE '1900-01-01' AS date, 85e0 AS ffmc, 6e0 AS dmc, 15e0 AS dc, 0e0 AS w
  FROM (SELECT DISTINCT era5_id FROM noon)
  UNION ALL
  SELECT era5_id, rn, date, ffmc, dmc, dc, w FROM (
    SELECT era5_id, rn, date, w,
      least(greatest(59.5e0 * (250e0 - m2) / (147.2e0 + m2), 0e0), 101e0) AS ffmc,
      p1 + 1e-6 * 189.4e0 * (greatest(tt, -11e-1) + 11e-1) * (100e0 - h)
        * list_extract([65e-1, 75e-1, 9e0, 128e-1, 139e-1, 139e-1, 124e-1, 109e-1, 94e-1, 8e0, 7e0, 6e0], mo) AS dmc,
      d1 + 5e-1 * greatest(36e-2 * (greatest(tt, -28e-1) + 28e-1)
        + list_extract([-16e-1, -16e-1, -16e-1, 9e-1, 38e-1, 58e-1, 64e-1, 5e0, 24e-1, 4e-1, -16e-1, -16e-1], mo), 0e0) AS dc
    FROM (
      SELECT *, CASE
          WHEN m1 > {DRY_SQL} THEN {DRY_SQL} + (m1 - {DRY_SQL}) * pow(10e0, -(
            (0.424e0 * (1e0 - pow(h / 100e0, 17e-1)) + 0.0694e0 * sqrt(w) * (1e0 - pow(h / 100e0, 8e0)))
            * 0.581e0 * exp(0.0365e0 * tt)))
          WHEN m1 < {WET_SQL} THEN {WET_SQL} - ({WET_SQL} - m1) * pow(10e0, -(
            (0.424e0 * (1e0 - pow((100e0 - h) / 100e0, 17e-1)) + 0.0694e0 * sqrt(w) * (1e0 - pow((100e0 - h) / 100e0, 8e0)))
            * 0.581e0 * exp(0.0365e0 * tt)))
          ELSE m1 END AS m2
      FROM (
        SELECT n.era5_id, n.rn, n.date, CAST(month(n.date) AS INT) AS mo, n.temp_noon AS tt, n.rh_noon AS h, n.wind_noon AS w,
          18e-2 * (211e-1 - n.temp_noon) * (1e0 - exp(-0.115e0 * n.rh_noon)) AS tail,
          CASE WHEN n.rain_noon > 5e-1 THEN least(250e0, c.m0 + 425e-1 * (n.rain_noon - 5e-1) * exp(-100e0 / (251e0 - c.m0))
              * (1e0 - exp(-6.93e0 / (n.rain_noon - 5e-1)))
              + CASE WHEN c.m0 > 150e0 THEN 15e-4 * pow(c.m0 - 150e0, 2) * sqrt(n.rain_noon - 5e-1) ELSE 0e0 END)
            ELSE c.m0 END AS m1,
          CASE WHEN n.rain_noon > 15e-1 THEN greatest(0e0, 244.72e0 - 43.43e0 * ln(
              1000e0 * (92e-2 * n.rain_noon - 127e-2) / (4877e-2 + (CASE WHEN c.dmc <= 33e0 THEN 100e0 / (5e-1 + 3e-1 * c.dmc)
                WHEN c.dmc <= 65e0 THEN 14e0 - 13e-1 * ln(c.dmc) ELSE 62e-1 * ln(c.dmc) - 172e-1 END)
                * (92e-2 * n.rain_noon - 127e-2)) + exp(5.6348e0 - c.dmc / 43.43e0)))
            ELSE c.dmc END AS p1,
          CASE WHEN n.rain_noon > 28e-1 THEN greatest(0e0, 400e0 * ln(800e0 / (800e0 * exp(-c.dc / 400e0)
              + 3.937e0 * (83e-2 * n.rain_noon - 127e-2)))) ELSE c.dc END AS d1
        FROM (SELECT *, 147.2e0 * (101e0 - ffmc) / (59.5e0 + ffmc) AS m0 FROM codes) c
        JOIN noon n ON n.era5_id = c.era5_id AND n.rn = c.rn + 1)))
),
indices AS (
  SELECT *, 0.208e0 * exp(0.05039e0 * w) * 919e-1 * exp(-0.1386e0 * m) * (1e0 + pow(m, 5.31e0) / 4.93e7) AS isi,
    CASE WHEN dmc = 0 AND dc = 0 THEN 0e0 WHEN dmc <= 4e-1 * dc THEN 8e-1 * dmc * dc / (dmc + 4e-1 * dc)
      ELSE greatest(0e0, dmc - (1e0 - 8e-1 * dc / (dmc + 4e-1 * dc)) * (92e-2 + pow(0.0114e0 * dmc, 17e-1))) END AS bui
  FROM (SELECT *, 147.2e0 * (101e0 - ffmc) / (59.5e0 + ffmc) AS m FROM codes WHERE rn > 0)
),
danger AS (SELECT *, 1e-1 * isi * CASE WHEN bui <= 80e0 THEN 0.626e0 * pow(bui, 0.809e0) + 2e0
  ELSE 1000e0 / (25e0 + 108.64e0 * exp(-0.023e0 * bui)) END AS b FROM indices)
SELECT era5_id, date, round(ffmc, 4) AS ffmc, round(dmc, 4) AS dmc, round(dc, 4) AS dc, round(isi, 4) AS isi,
  round(bui, 4) AS bui, round(CASE WHEN b > 1e0 THEN exp(2.72e0 * pow(0.434e0 * ln(b), 0.647e0)) ELSE b END, 4) AS fwi
FROM danger"""


def noon_inputs(t: Tables):
    return t.daily().select(
        "era5_id",
        "date",
        (F.col("temp_mean") - 5.0).alias("temp_noon"),
        F.least(F.col("rh_mean") * 1.8, F.lit(100.0)).alias("rh_noon"),
        (F.col("wind_speed_mean") * 3.0).alias("wind_noon"),
        (F.greatest(F.col("precip_sum") - 150.0, F.lit(0.0)) / 10.0).alias("rain_noon"),
    )


@query("f12_fire_weather", FWI_SQL)
def fire_weather_codes(t: Tables):
    codes = fire_weather.fire_weather(
        noon_inputs(t), "era5_id", "date", "temp_noon", "rh_noon", "wind_noon", "rain_noon"
    )
    return codes.select(
        "era5_id",
        "date",
        *(F.round(c, 4).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")),
    )


@query(
    "f13_day_over_day",
    f"WITH {WITH_DAILY} SELECT era5_id, date, round(temp_mean - lag(temp_mean) OVER (PARTITION BY era5_id ORDER BY "
    "date), 9) + 0e0 AS temp_change FROM daily",
)
def day_over_day(t: Tables):
    return t.daily().select(
        "era5_id",
        "date",
        (F.round(w.change(CELL, "date", "temp_mean"), 9) + F.lit(0.0)).alias("temp_change"),
    )
