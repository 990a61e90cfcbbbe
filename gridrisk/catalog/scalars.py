"""Section B: projections, scalar repair, dates and physics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import (
    WITH_CELL_DAYS,
    WITH_DAILY,
    WITH_FIRES,
    WITH_GRID,
    WITH_HOURLY,
    WITH_SCORES,
    Tables,
)
from gridrisk.functions import calendar, geometry, lookup, physics, repair
from gridrisk.operators import events as ev
from gridrisk.operators import landcover as lc
from gridrisk.operators import terrain as tr

# the raw event fields: text, some holding a full date or time where one number belongs
RAW_FIELDS = {
    "start_day": "CASE WHEN o_orderkey % 11 = 0 THEN concat(' ', CAST(day(o_orderdate) AS STRING), "
    "'/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING), ' ') "
    "WHEN o_orderkey % 13 = 0 THEN 'abc' WHEN o_orderkey % 31 = 0 THEN '31' "
    "ELSE CAST(day(o_orderdate) AS STRING) END",
    "start_month": "CASE WHEN o_orderkey % 31 = 0 THEN '2' "
    "ELSE CAST(month(o_orderdate) AS STRING) END",
    "start_year": "CAST(year(o_orderdate) AS STRING)",
    "start_hour": "CASE WHEN o_orderkey % 17 = 0 THEN '21:30:05' WHEN o_orderkey % 19 = 0 THEN '99' "
    "WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 24 AS STRING) END",
    "start_minute": "CASE WHEN o_orderkey % 17 = 0 THEN '21:30:05' "
    "ELSE CAST(o_orderkey % 60 AS STRING) END",
}
RAW = [f"{text} AS {name}" for name, text in RAW_FIELDS.items()]
RAW_SQL = (
    "raw AS (SELECT o_orderkey AS fire_id, "
    + ", ".join(RAW).replace("AS STRING", "AS VARCHAR")
    + ", o_totalprice, o_custkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders)"
)


def raw_events(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey AS fire_id",
        *RAW,
        "o_totalprice",
        "o_custkey",
        "o_orderpriority",
        "o_orderstatus",
        "o_orderdate",
    )


def _part(name: str, group: int, shape: str) -> str:
    pattern = (
        r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
        if shape == "date"
        else r"^\s*(\d{1,2}):(\d{1,2})(:\d{1,2})?\s*$"
    )
    return (
        f"TRY_CAST(CASE WHEN regexp_matches(trim({name}), '{pattern}') "
        f"THEN regexp_extract(trim({name}), '{pattern}', {group}) ELSE trim({name}) END AS DOUBLE)"
    )


def _hit(name: str, shape: str) -> str:
    pattern = (
        r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
        if shape == "date"
        else r"^\s*(\d{1,2}):(\d{1,2})(:\d{1,2})?\s*$"
    )
    return f"coalesce(regexp_matches(trim({name}), '{pattern}'), false)"


PARSED = (
    "parsed AS (SELECT *, "
    + ", ".join(
        f"{_part(f'start_{c}', g, s)} AS v_{c}, {_hit(f'start_{c}', s)} AS h_{c}"
        for c, g, s in (
            ("day", 1, "date"),
            ("month", 2, "date"),
            ("year", 3, "date"),
            ("hour", 1, "time"),
            ("minute", 2, "time"),
        )
    )
    + " FROM raw)"
)

STAMP = (
    "stamped AS (SELECT *, "
    "CASE WHEN v_hour BETWEEN 0 AND 23 THEN v_hour ELSE 0 END AS c_hour, "
    "CASE WHEN v_minute BETWEEN 0 AND 59 THEN v_minute ELSE 0 END AS c_minute FROM parsed), "
    "dated AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:00', v_year::INT, v_month::INT, "
    "v_day::INT, c_hour::INT, c_minute::INT) AS TIMESTAMP) AS start_datetime FROM stamped)"
)


@query(
    "b01_component_repair",
    f"WITH {RAW_SQL}, {PARSED} SELECT fire_id, v_day AS day_value, h_day AS day_repaired, "
    "v_hour AS hour_value, h_hour AS hour_repaired FROM parsed",
)
def component_repair(t: Tables):
    day, day_fixed = repair.normalize_component(F.col("start_day"), "day")
    hour, hour_fixed = repair.normalize_component(F.col("start_hour"), "hour")
    return raw_events(t).select(
        "fire_id",
        day.alias("day_value"),
        day_fixed.alias("day_repaired"),
        hour.alias("hour_value"),
        hour_fixed.alias("hour_repaired"),
    )


@query(
    "b02_field_group_repair",
    f"WITH {RAW_SQL}, {PARSED} SELECT fire_id, v_day AS day, v_month AS month, v_year AS year, "
    "v_hour AS hour, v_minute AS minute, h_day OR h_month OR h_year OR h_hour OR h_minute "
    "AS repaired FROM parsed",
)
def field_group_repair(t: Tables):
    values, fixed = repair.normalize_fields([F.col(name) for name in RAW_FIELDS])
    return raw_events(t).select(
        "fire_id", *(v.alias(k) for k, v in values.items()), fixed.alias("repaired")
    )


@query(
    "b03_clamp",
    "SELECT event_id, CASE WHEN value BETWEEN 0 AND 59 THEN value ELSE 0 END AS minute FROM events",
)
def clamp(t: Tables):
    return t.events.select("event_id", repair.clamp(F.col("value"), 59).alias("minute"))


@query(
    "b04_timestamp_assembly",
    f"WITH {RAW_SQL}, {PARSED}, {STAMP} SELECT fire_id, start_datetime FROM dated",
)
def timestamp_assembly(t: Tables):
    values, _ = repair.normalize_fields([F.col(name) for name in RAW_FIELDS])
    return raw_events(t).select(
        "fire_id", repair.build_datetime(*values.values()).alias("start_datetime")
    )


@query(
    "b05_near_midnight",
    f"WITH {WITH_FIRES} SELECT fire_id, coalesce(h >= 22 OR h < 2, false) AS near_midnight FROM "
    "(SELECT fire_id, CASE WHEN fire_id % 23 = 0 THEN NULL ELSE start_hour END AS h FROM fires)",
)
def near_midnight(t: Tables):
    hour = F.when(F.col("fire_id") % 23 != 0, F.col("start_hour"))
    return t.fires().select("fire_id", repair.near_midnight(hour).alias("near_midnight"))


@query(
    "b06_suspicious_default_time",
    f"WITH {WITH_FIRES} SELECT fire_id, coalesce(h BETWEEN 0 AND 2, false) AS suspicious FROM "
    "(SELECT fire_id, CASE WHEN fire_id % 23 = 0 THEN NULL ELSE start_hour END AS h FROM fires)",
)
def suspicious_default_time(t: Tables):
    hour = F.when(F.col("fire_id") % 23 != 0, F.col("start_hour"))
    return t.fires().select("fire_id", repair.suspicious_default_time(hour).alias("suspicious"))


@query(
    "b07_event_table",
    f"WITH {RAW_SQL}, {PARSED}, {STAMP} SELECT fire_id, 6e5 + (o_custkey % 40) * 5e2 AS x, "
    "52e5 - (o_custkey // 40) * 5e2 AS y, start_datetime, CAST(NULL AS TIMESTAMP) AS end_datetime, "
    "CAST(start_datetime AS DATE) AS ignition_date, CAST(v_hour AS BIGINT) AS start_hour, "
    "o_totalprice / 1e3 AS area_ha, fire_id % 12 AS cause, o_orderpriority AS loc, "
    "CAST(year(o_orderdate) AS BIGINT) AS registered_year, CAST(NULL AS BIGINT) AS duration_min, "
    "coalesce(v_hour >= 22 OR v_hour < 2, false) AS near_midnight, "
    "coalesce(v_hour BETWEEN 0 AND 2, false) AS suspicious_default_time, "
    "'centroid' AS ignition_point_method, "
    "h_day OR h_month OR h_year OR h_hour OR h_minute AS date_format_normalized FROM dated",
)
def event_table(t: Tables):
    fields = {name: F.col(name) for name in RAW_FIELDS}
    fields |= {name.replace("start_", "end_"): F.lit(None).cast("string") for name in RAW_FIELDS}
    fields |= {
        "fire_id": F.col("fire_id").cast("string"),
        "x": F.lit(6e5) + (F.col("o_custkey") % 40) * F.lit(5e2),
        "y": F.lit(52e5) - F.floor(F.col("o_custkey") / 40) * F.lit(5e2),
        "area_ha": F.col("o_totalprice") / F.lit(1e3),
        "cause": F.col("fire_id") % 12,
        "loc": F.col("o_orderpriority"),
        "registered_year": F.year("o_orderdate"),
        "duration_min": F.lit("unknown"),
        "point_method": F.lit("centroid"),
    }
    return ev.build_events(raw_events(t), fields)


@query(
    "b08_event_span",
    f"WITH {WITH_FIRES} SELECT fire_id, ignition_date AS start_date, "
    "greatest(coalesce(end_date_raw, ignition_date), ignition_date) AS end_date FROM fires",
)
def event_span(t: Tables):
    start, end = repair.event_span(F.col("ignition_date"), F.col("end_date_raw"))
    return t.fires().select("fire_id", start.alias("start_date"), end.alias("end_date"))


@query(
    "b09_day_first_and_comma",
    "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') "
    "WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '  ' END AS d, "
    "CASE WHEN o_orderkey % 4 = 0 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') "
    "WHEN o_orderkey % 4 = 1 THEN ' ' ELSE CAST(o_totalprice AS VARCHAR) END AS a FROM orders) "
    "SELECT o_orderkey, coalesce(CAST(try_strptime(d, '%d/%m/%Y') AS DATE), TRY_CAST(nullif(trim(d), '') AS DATE)) "
    "AS case_date, TRY_CAST(replace(nullif(trim(a), ''), ',', '.') AS DOUBLE) AS area FROM t",
)
def day_first_and_comma(t: Tables):
    key = F.col("o_orderkey")
    day = (
        F.when(key % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy"))
        .when(key % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.lit("  "))
    )
    text = F.col("o_totalprice").cast("string")
    area = (
        F.when(key % 4 == 0, F.replace(text, F.lit("."), F.lit(",")))
        .when(key % 4 == 1, F.lit(" "))
        .otherwise(text)
    )
    return t.orders.select(
        "o_orderkey",
        repair.day_first_date(day).alias("case_date"),
        repair.decimal_comma(area).alias("area"),
    )


SCALING = {
    "temp_f": ("temp_c", 1.8, 32.0),
    "pres_pa": ("pres_hpa", 100.0, 0.0),
    "precip_m": ("precip_mm", 0.001, 0.0),
}


@query(
    "b10_unit_conversion",
    f"WITH {WITH_HOURLY} SELECT event_id, round(temp_c * 18e-1 + 32e0, 6) AS temp_f, "
    "pres_hpa * 1e2 + 0e0 AS pres_pa, round(precip_mm * 1e-3 + 0e0, 6) AS precip_m FROM hourly",
)
def unit_conversion(t: Tables):
    scaled = physics.rescale(t.hourly(), SCALING)
    return scaled.select(
        "event_id", F.round("temp_f", 6).alias("temp_f"), "pres_pa", F.round("precip_m", 6).alias("precip_m")
    )


MAGNUS = "exp(17.625e0 * dewpoint_c / (243.04e0 + dewpoint_c) - 17.625e0 * temp_c / (243.04e0 + temp_c))"
HUMIDITY = f"least(greatest(1e2 * {MAGNUS}, 0e0), 1e2)"
DEFICIT = (
    "greatest(6.1094e0 * exp(17.625e0 * temp_c / (243.04e0 + temp_c)) - "
    "6.1094e0 * exp(17.625e0 * dewpoint_c / (243.04e0 + dewpoint_c)), 0e0)"
)
SPEED = "sqrt(u10 * u10 + v10 * v10)"
BEARING = "((270e0 - degrees(atan2(v10, u10))) % 360e0 + 360e0) % 360e0"


@query(
    "b11_relative_humidity",
    f"WITH {WITH_HOURLY} SELECT event_id, round({HUMIDITY}, 6) AS rh, "
    f"round(1e2 * {MAGNUS}, 6) AS rh_unclipped FROM hourly",
)
def relative_humidity(t: Tables):
    pair = (F.col("temp_c"), F.col("dewpoint_c"))
    return t.hourly().select(
        "event_id",
        F.round(physics.relative_humidity(*pair), 6).alias("rh"),
        F.round(physics.unclipped_humidity(*pair), 6).alias("rh_unclipped"),
    )


@query(
    "b12_vapor_pressure_deficit",
    f"WITH {WITH_HOURLY} SELECT event_id, round({DEFICIT}, 6) AS vpd FROM hourly",
)
def vapor_pressure_deficit(t: Tables):
    vpd = physics.vapor_pressure_deficit(F.col("temp_c"), F.col("dewpoint_c"))
    return t.hourly().select("event_id", F.round(vpd, 6).alias("vpd"))


@query(
    "b13_wind",
    f"WITH {WITH_HOURLY} SELECT event_id, round({SPEED}, 6) AS speed, "
    f"round({BEARING}, 6) AS bearing FROM hourly",
)
def wind(t: Tables):
    u, v = F.col("u10"), F.col("v10")
    return t.hourly().select(
        "event_id",
        F.round(physics.wind_speed(u, v), 6).alias("speed"),
        F.round(physics.wind_from(u, v), 6).alias("bearing"),
    )


@query(
    "b14_bearing_wrap",
    "WITH b AS (SELECT event_id, ((value * 7e0 - 1e3) % 36e1 + 36e1) % 36e1 AS w FROM events) "
    "SELECT event_id, CAST(CASE WHEN CAST(w AS FLOAT) >= 360 THEN 0 ELSE CAST(w AS FLOAT) END AS FLOAT) "
    "AS bearing FROM b",
)
def bearing_wrap(t: Tables):
    angle = F.col("value") * F.lit(7.0) - F.lit(1000.0)
    return t.events.select("event_id", physics.stored_bearing(angle).alias("bearing"))


EASTER = (
    "y AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), "
    "e1 AS (SELECT date, year(date) AS yr, year(date) % 19 AS a, year(date) // 100 AS b, "
    "year(date) % 100 AS c FROM y), "
    "e2 AS (SELECT *, b // 4 AS d, b % 4 AS e, (b - (b + 8) // 25 + 1) // 3 AS g, c // 4 AS i, "
    "c % 4 AS k FROM e1), "
    "e3 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM e2), "
    "e4 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM e3), "
    "e5 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e4), "
    "e6 AS (SELECT *, make_date(yr, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) "
    "AS easter FROM e5)"
)


@query(
    "b15_calendar_features",
    f"WITH {EASTER} SELECT date, CAST(month(date) AS TINYINT) AS month, "
    "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' "
    "WHEN month(date) <= 8 THEN 'summer' ELSE 'autumn' END AS season, "
    "CAST(isodow(date) - 1 AS TINYINT) AS day_of_week, isodow(date) >= 6 AS is_weekend, "
    "strftime(date, '%m-%d') IN ('01-01', '01-06', '04-25', '05-01', '06-02', '08-15', '11-01', "
    "'12-08', '12-25', '12-26') OR date = easter OR date = easter + 1 AS is_holiday FROM e6",
)
def calendar_features(t: Tables):
    return calendar.calendar_features(
        t.orders.select(F.to_date("o_orderdate").alias("date"))
    )


@query(
    "b16_span_generators",
    "WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b "
    "FROM orders GROUP BY o_custkey) "
    "SELECT o_custkey, "
    "CAST(date_diff('month', a, b) + 1 AS INT) AS months, "
    "CAST(floor(date_diff('day', a, b) / 7) + 1 AS INT) AS every_7th_day, "
    "CAST(date_trunc('month', a) - INTERVAL 1 MONTH AS DATE) AS month_before, "
    "CAST(date_diff('month', a - 120, a) + 1 AS INT) AS months_in_reach, "
    "CAST((SELECT count(*) FROM range(0, 200) m(i) WHERE date_trunc('month', a) + to_months(i::INT) <= b AND "
    "greatest(CAST(date_trunc('month', a) + to_months(i::INT) AS DATE), a) <= "
    "least(CAST(date_trunc('month', a) + to_months(i::INT) AS DATE) + 9, b)) AS INT) AS opening_spans, "
    "CAST(make_date(year(a), ((month(a) - 1) // 3) * 3 + 1, 1) AS DATE) AS chunk, "
    "CAST((year(b) * 2 + CASE WHEN month(b) <= 6 THEN 0 ELSE 1 END) - "
    "(year(a) * 2 + CASE WHEN month(a) <= 6 THEN 0 ELSE 1 END) + 1 AS INT) AS half_years, "
    "CAST(date_diff('day', a, b) + 1 AS INT) AS half_year_days, "
    "CAST(date_trunc('month', a - 90) AS DATE) AS spinup_start, "
    "least(last_day(b), a + 10) AS spinup_end, make_date(year(b), 8, 15) AS window_end FROM s",
)
def span_generators(t: Tables):
    spans = t.orders.groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    halves = calendar.half_years(a, b)
    spin = calendar.spinup_window(a, b, a, 90, 10)
    days = F.aggregate(
        halves, F.lit(0), lambda acc, h: acc + F.date_diff(h["to_day"], h["from_day"])
    )
    return spans.select(
        "o_custkey",
        F.size(calendar.month_starts(a, b)).alias("months"),
        F.size(calendar.days_between(a, b, 7)).alias("every_7th_day"),
        calendar.preceding_month(a).alias("month_before"),
        F.size(calendar.months_in_reach(a, 120)).alias("months_in_reach"),
        F.size(calendar.opening_days(a, b)).alias("opening_spans"),
        calendar.chunk_start(a, 3).alias("chunk"),
        F.size(halves).alias("half_years"),
        days.alias("half_year_days"),
        spin["start"].alias("spinup_start"),
        spin["end"].alias("spinup_end"),
        F.element_at(calendar.season_window(F.year(b)), -1).alias("window_end"),
    )


PERIODS = ((1995, 1996), (1997, 1998), (1999, 2001))


@query(
    "b17_bins",
    f"WITH {WITH_FIRES}, d AS (SELECT *, CASE WHEN year >= 2000 THEN 2000 WHEN year >= 1997 THEN 1997 "
    "ELSE 1990 END AS s FROM fires), n AS (SELECT s, min(year) || '-' || max(year) AS decade FROM d "
    "GROUP BY s) SELECT fire_id, decade, CASE WHEN year <= 1996 THEN '1995-1996' WHEN year <= 1998 "
    "THEN '1997-1998' ELSE '1999-2001' END AS period, CASE WHEN area_ha >= 100 THEN 100 WHEN area_ha "
    ">= 10 THEN 10 WHEN area_ha >= 0 THEN 0 END AS size_from, printf('%02d-%02d', (start_hour // 3) * 3, "
    "(start_hour // 3) * 3 + 2) AS hours FROM d JOIN n USING (s)",
)
def bins(t: Tables):
    tagged = calendar.decade_labels(t.fires(), "year", (1990, 1997, 2000))
    return tagged.select(
        "fire_id",
        "decade",
        calendar.period_label(F.col("year"), PERIODS).alias("period"),
        calendar.bin_start(F.col("area_ha"), (0, 10, 100)).cast("int").alias("size_from"),
        calendar.bin_label(F.col("start_hour"), tuple(range(0, 25, 3))).alias("hours"),
    )


@query(
    "b18_modeling_window",
    f"WITH {WITH_DAILY} SELECT era5_id, count(*) AS rows, count(*) FILTER (year(date) >= 2000) AS "
    "test_rows FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' GROUP BY era5_id",
)
def modeling_window(t: Tables):
    inside = t.daily().where(F.col("date").between("1996-01-01", "2001-06-30"))
    return inside.groupBy("era5_id").agg(
        F.count("*").alias("rows"), F.count_if(F.year("date") >= 2000).alias("test_rows")
    )


@query(
    "b19_plausibility",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice / 5e4 - 1e0 BETWEEN -1 AND 1 "
    "THEN l_extendedprice / 5e4 - 1e0 END AS ndvi, CASE WHEN l_quantity * 2e0 - 4e1 BETWEEN -30 AND 55 "
    "THEN l_quantity * 2e0 - 4e1 END AS lst FROM lineitem",
)
def plausibility(t: Tables):
    from gridrisk.operators.climate import plausible

    raw = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / F.lit(5e4) - F.lit(1.0)).alias("ndvi"),
        (F.col("l_quantity") * F.lit(2.0) - F.lit(40.0)).alias("lst"),
    )
    return plausible(raw, {"ndvi": (-1.0, 1.0), "lst": (-30.0, 55.0)})


@query(
    "b20_recency_weights",
    f"WITH {WITH_FIRES} SELECT fire_id, round(pow(5e-1, (2001 - year) / 3e0), 9) AS weight FROM fires",
)
def recency_weights(t: Tables):
    return t.fires().select(
        "fire_id", F.round(physics.recency_weight(F.col("year"), 2001, 3.0), 9).alias("weight")
    )


@query(
    "b21_logit",
    f"WITH {WITH_SCORES}, p AS (SELECT row_id, least(greatest(score, 1e-9), 1e0 - 1e-9) AS p FROM scores) "
    "SELECT row_id, round(ln(p / (1e0 - p)), 6) AS z, round(1e0 / (1e0 + exp(-ln(p / (1e0 - p)))), 6) "
    "AS back FROM p",
)
def logit(t: Tables):
    z = physics.logit(F.col("score"))
    return t.scores().select(
        "row_id", F.round(z, 6).alias("z"), F.round(physics.inverse_logit(z), 6).alias("back")
    )


KNOTS_X = (0.1, 0.2, 0.35, 0.6, 0.8)
KNOTS_Y = (0.0, 0.05, 0.2, 0.5, 0.9)


def _interp(value: str, xs, ys) -> str:
    arms = [f"WHEN {value} < {xs[0]:e} THEN {ys[0]:e}"]
    for x0, x1, y0, y1 in zip(xs[:-1], xs[1:], ys[:-1], ys[1:]):
        slope = (y1 - y0) / (x1 - x0)
        arms.append(f"WHEN {value} < {x1:e} THEN {y0:e} + {slope:.17e} * ({value} - {x0:e})")
    return f"CASE {' '.join(arms)} ELSE {ys[-1]:e} END"


@query(
    "b22_piecewise_linear",
    f"WITH {WITH_SCORES} SELECT row_id, round({_interp('score', KNOTS_X, KNOTS_Y)}, 6) AS mapped FROM scores",
)
def piecewise_linear(t: Tables):
    mapped = lookup.interpolate(F.col("score"), lookup.knots(KNOTS_X, KNOTS_Y))
    return t.scores().select("row_id", F.round(mapped, 6).alias("mapped"))


RUNGS = (-10, -5, 0, 5, 10)


def _hourly_rungs(t: Tables):
    columns = {
        physics.rung_column("rh_min", r): physics.unclipped_humidity(
            F.col("temp_c") + F.lit(float(r)), F.col("dewpoint_c")
        )
        for r in RUNGS
    }
    columns |= {
        physics.rung_column("rh_max", r): physics.unclipped_humidity(
            F.col("temp_c") + F.lit(float(r) + 1.0), F.col("dewpoint_c")
        )
        for r in RUNGS
    }
    offset = F.lit(-10.0) + F.col("event_id") % 200 / F.lit(10.0)
    return t.hourly().withColumns(columns).withColumn("lapse_offset_k", offset)


def _rung_sql(shift: float) -> str:
    def at(r):
        return (
            f"1e2 * exp(17.625e0 * dewpoint_c / (243.04e0 + dewpoint_c) - 17.625e0 * (temp_c + {r + shift:e})"
            f" / (243.04e0 + temp_c + {r + shift:e}))"
        )

    arms = []
    for low, high in zip(RUNGS[:-1], RUNGS[1:]):
        f = f"((o - {low:e}) / 5e0)"
        arms.append(f"WHEN o < {high:e} THEN (1e0 - {f}) * {at(low)} + {f} * {at(high)}")
    return f"CASE {' '.join(arms)} END"


LAPSE_SQL = (
    f"WITH {WITH_HOURLY}, h AS (SELECT *, -1e1 + event_id % 200 / 1e1 AS o FROM hourly), "
    f"b AS (SELECT event_id, temp_c, o, {_rung_sql(0)} AS lo, {_rung_sql(1)} AS hi FROM h) "
)


@query("b23_rung_blend", LAPSE_SQL + "SELECT event_id, round(lo, 5) AS rh FROM b")
def rung_blend(t: Tables):
    values = [F.col(physics.rung_column("rh_min", r)) for r in RUNGS]
    blended = physics.blend_rungs(values, RUNGS, F.col("lapse_offset_k"))
    return _hourly_rungs(t).select("event_id", F.round(blended, 5).alias("rh"))


@query(
    "b24_lapse_correction",
    LAPSE_SQL + "SELECT event_id, round(CAST(temp_c + o AS FLOAT)::DOUBLE, 2) AS temp_c_lapse, "
    "round(CAST(least(greatest(lo, 0), 100) AS FLOAT)::DOUBLE, 2) AS rh_min_lapse, "
    "round(CAST(least(greatest(hi, 0), 100) AS FLOAT)::DOUBLE, 2) AS rh_max_lapse, "
    "round(CAST(least(greatest(hi, 0), 100) - least(greatest(lo, 0), 100) AS FLOAT)::DOUBLE, 2) + 0e0 "
    "AS rh_range_lapse FROM b",
)
def lapse_correction(t: Tables):
    names = ("rh_min", "rh_max")
    out = physics.apply_lapse(
        _hourly_rungs(t), "lapse_offset_k", RUNGS, ("temp_c",), names, names
    )
    columns = ("temp_c_lapse", "rh_min_lapse", "rh_max_lapse", "rh_range_lapse")
    return out.select(
        "event_id", *((F.round(F.col(c).cast("double"), 2) + F.lit(0.0)).alias(c) for c in columns)
    )


@query(
    "b25_lapse_offset",
    f"WITH {WITH_GRID}, w AS (SELECT cell_id, elevation, unnest([c_nationkey, c_nationkey + 1]) AS node, "
    "unnest([25e-2, 75e-2]) AS weight FROM grid) SELECT cell_id, round(-65e-1 * (any_value(elevation) - "
    "sum(weight * (node * 4e1))) / 1e3, 6) + 0e0 AS lapse_offset_k FROM w GROUP BY cell_id",
)
def lapse_offset(t: Tables):
    from gridrisk.operators.climate import lapse_offsets

    grid = t.grid()
    weights = grid.select(
        "cell_id",
        F.explode(
            F.array(
                F.struct(F.col("c_nationkey").alias("node"), F.lit(0.25).alias("weight")),
                F.struct((F.col("c_nationkey") + 1).alias("node"), F.lit(0.75).alias("weight")),
            )
        ).alias("w"),
    ).select("cell_id", "w.node", "w.weight")
    heights = (
        grid.select(F.explode(F.array("c_nationkey", F.col("c_nationkey") + 1)).alias("node"))
        .distinct()
        .withColumn("height", F.col("node") * F.lit(40.0))
    )
    out = lapse_offsets(weights, heights, grid.select("cell_id", "elevation"), node="node")
    return out.select("cell_id", (F.round("lapse_offset_k", 6) + F.lit(0.0)).alias("lapse_offset_k"))


@query(
    "b26_qa_bits",
    "WITH q AS (SELECT event_id, event_id % 64 AS qa FROM events) SELECT event_id, (qa & 63) = 0 AS clear, "
    "CASE WHEN (qa & 31) = 0 THEN CAST((qa >> 5) & 1 AS INT) END AS snow FROM q",
)
def qa_bits(t: Tables):
    clear, snow = tr.quality_bits(F.col("event_id") % 64, mask_snow=True)
    return t.events.select("event_id", clear.alias("clear"), snow.alias("snow"))


@query(
    "b27_spectral_indices",
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS old, l_partkey * 7 % 20000 + 8000 AS dn_red, "
    "l_partkey * 11 % 20000 + 9000 AS dn_nir, l_suppkey * 13 % 20000 + 8500 AS dn_swir1, "
    "l_suppkey * 17 % 20000 + 8200 AS dn_swir2, l_orderkey % 10000 + 40000 AS dn_thermal FROM lineitem), "
    "r AS (SELECT *, "
    + ", ".join(
        f"CASE WHEN old THEN (dn_{b} * 2.75e-5 - 2e-1) * {slope:e} + {shift:e} "
        f"ELSE dn_{b} * 2.75e-5 - 2e-1 END AS {b}"
        for b, slope, shift in (
            ("red", 0.9047, 0.0061),
            ("nir", 0.8462, 0.0412),
            ("swir1", 0.8937, 0.0254),
            ("swir2", 0.9071, 0.0172),
        )
    )
    + " FROM s) SELECT l_orderkey, l_linenumber, round((nir - red) / nullif(nir + red, 0), 6) + 0e0 AS ndvi, "
    "round((nir - swir1) / nullif(nir + swir1, 0), 6) + 0e0 AS ndwi, "
    "round((nir - swir2) / nullif(nir + swir2, 0), 6) + 0e0 AS nbr, "
    "round(dn_thermal * 0.00341802e0 + 149e0 - 273.15e0, 6) AS lst FROM r",
)
def spectral_indices(t: Tables):
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    scenes = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "O", F.lit("LT05")).otherwise(F.lit("LC08")).alias("sensor"),
        (part * 7 % 20000 + 8000).alias("red"),
        (part * 11 % 20000 + 9000).alias("nir"),
        (supp * 13 % 20000 + 8500).alias("swir1"),
        (supp * 17 % 20000 + 8200).alias("swir2"),
        (order % 10000 + 40000).alias("thermal"),
    )
    out = tr.spectral_indices(scenes, "sensor")
    return out.select(
        "l_orderkey",
        "l_linenumber",
        *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("ndvi", "ndwi", "nbr")),
        F.round("lst", 6).alias("lst"),
    )


@query(
    "b28_aspect",
    "WITH a AS (SELECT l_suppkey AS cell_id, CAST(floor(((l_partkey % 3600) / 1e1 + 225e-1) % 36e1 / 45e0) + 1 "
    "AS INT) AS sector FROM lineitem), s AS (SELECT cell_id, sector, count(*) * 1e0 / sum(count(*)) OVER "
    "(PARTITION BY cell_id) AS frac FROM a GROUP BY cell_id, sector) "
    "SELECT cell_id, round(sum(frac * cos(radians((sector - 1) * 45e0))), 6) + 0e0 AS northness, "
    "round(sum(frac * sin(radians((sector - 1) * 45e0))), 6) + 0e0 AS eastness FROM s GROUP BY cell_id",
)
def aspect(t: Tables):
    sector = tr.aspect_sector(F.col("l_partkey") % 3600 / F.lit(10.0))
    shares = tr.class_shares(
        t.lineitem.select(F.col("l_suppkey").alias("cell_id"), sector.alias("sector")),
        "cell_id",
        "sector",
        list(range(1, 9)),
        "aspect_",
    )
    north, east = tr.aspect_components([F.col(f"aspect_{i}") for i in range(1, 9)])
    return shares.select(
        "cell_id",
        (F.round(north, 6) + F.lit(0.0)).alias("northness"),
        (F.round(east, 6) + F.lit(0.0)).alias("eastness"),
    )


@query(
    "b29_class_regrouping",
    "WITH c AS (SELECT l_suppkey AS cell_id, l_partkey % 44 + 1 AS code FROM lineitem), "
    "m AS (SELECT *, CASE WHEN code <= 2 THEN 11 WHEN code <= 6 THEN 12 WHEN code <= 9 THEN 13 WHEN code <= 11 "
    "THEN 14 WHEN code <= 14 THEN 21 WHEN code <= 17 THEN 22 WHEN code <= 18 THEN 23 WHEN code <= 22 THEN 24 "
    "WHEN code <= 25 THEN 31 WHEN code <= 29 THEN 32 WHEN code <= 34 THEN 33 WHEN code <= 36 THEN 41 WHEN code "
    "<= 39 THEN 42 WHEN code <= 41 THEN 51 ELSE 52 END AS level2 FROM c) "
    "SELECT cell_id, CAST(level2 AS INT) AS level2, CAST(level2 // 10 AS INT) AS level1, "
    "round(count(*) / sum(count(*)) OVER (PARTITION BY cell_id), 6) AS share FROM m GROUP BY cell_id, level2",
)
def class_regrouping(t: Tables):
    pixels = t.lineitem.select(
        F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 44 + 1).cast("int").alias("code")
    )
    shares = lc.code_shares(pixels, "cell_id", "code")
    return lc.regroup(shares, "cell_id", level=2).select(
        "cell_id",
        F.col("parent").alias("level2"),
        F.floor(F.col("parent") / 10).cast("int").alias("level1"),
        F.round("share", 6).alias("share"),
    )


@query(
    "b30_dominant_class",
    "WITH c AS (SELECT l_suppkey AS cell_id, count(*) FILTER (l_returnflag = 'A') AS a, "
    "count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem "
    "GROUP BY l_suppkey) SELECT cell_id, CASE WHEN a >= n AND a >= r THEN 'a' WHEN n >= r THEN 'n' ELSE 'r' END "
    "AS dominant FROM c",
)
def dominant_class(t: Tables):
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("cell_id")).agg(
        *(F.count_if(F.col("l_returnflag") == f).alias(f.lower()) for f in ("A", "N", "R"))
    )
    return counts.select("cell_id", lc.dominant(["a", "n", "r"]).alias("dominant"))


@query(
    "b31_feature_vector",
    "SELECT era5_id, date, temp_mean AS t2m, rh_mean / 1e2 AS rh, wind_speed_mean AS wind_speed, "
    "precip_sum / 1e3 AS tp, temp_max - temp_min AS t_range FROM "
    f"(WITH {WITH_DAILY} SELECT * FROM daily)",
)
def feature_vector(t: Tables):
    from gridrisk.operators.models import adapt

    mapping = {
        "t2m": F.col("temp_mean"),
        "rh": F.col("rh_mean") / F.lit(100.0),
        "wind_speed": F.col("wind_speed_mean"),
        "tp": F.col("precip_sum") / F.lit(1000.0),
        "t_range": F.col("temp_max") - F.col("temp_min"),
    }
    return adapt(t.daily(), mapping, list(mapping), keep=("era5_id", "date"))


@query(
    "b33_design_matrix",
    f"WITH {WITH_FIRES} SELECT fire_id, CAST(area_ha AS FLOAT) AS area_ha, "
    + ", ".join(
        f"CAST(CASE WHEN month(ignition_date) IN {months} THEN 1 ELSE 0 END AS FLOAT) AS season_{name}"
        for name, months in calendar.SEASONS.items()
    )
    + ", CAST(CASE WHEN cause = 10 THEN 1 ELSE 0 END AS TINYINT) AS label, CAST(year AS INT) AS year FROM fires",
)
def design_matrix(t: Tables):
    from gridrisk.operators.models import design_matrix as design

    fires = t.fires().withColumn("season", calendar.season(F.month("ignition_date")))
    return design(
        fires,
        keys=("fire_id",),
        numeric=("area_ha",),
        categories={"season": tuple(calendar.SEASONS)},
        label=F.col("cause") == 10,
        year=F.col("year"),
    )


@query("b35_projection")
def projection(t: Tables):
    lon, lat = geometry.from_utm(F.col("x"), F.col("y"))
    x, y = geometry.to_utm(lon, lat)
    return t.grid().select(
        "cell_id",
        F.round(lon, 7).alias("lon"),
        F.round(lat, 7).alias("lat"),
        F.round(F.hypot(x - F.col("x"), y - F.col("y")), 4).alias("round_trip_m"),
    )


@query(
    "b36_return_period",
    f"WITH {WITH_CELL_DAYS} SELECT cell_id, date, round(1e0 / (nullif(raw, 0) * 365.25e0), 8) AS years FROM cell_days",
)
def return_period(t: Tables):
    return t.cell_days().select(
        "cell_id", "date", F.round(physics.return_period_years(F.col("raw")), 8).alias("years")
    )
