"""Section A: scans, decoders, contracts and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import (
    WITH_CELL_DAYS,
    WITH_DAILY,
    WITH_FIRES,
    WITH_GRID,
    WITH_HOURLY,
    Tables,
)
from gridrisk.functions import geometry as geo
from gridrisk.operators import events as ev
from gridrisk.operators.ordering import running_sums
from gridrisk.operators.ranking import labelled_union
from gridrisk.session import fresh_path
from gridrisk.sources import features as ft
from gridrisk.sources import payloads as pl
from gridrisk.sources import records as rc
from gridrisk.sources import registry as rg
from gridrisk.sources import tables as tb


@query(
    "a01_table_scan",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 13 THEN l_quantity END AS quantity, l_shipdate FROM lineitem",
)
def table_scan(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") == 13, F.lit(float("nan")))
        .otherwise(F.col("l_quantity"))
        .alias("quantity"),
        "l_shipdate",
    )
    return tb.nan_to_null(rows)


DAYS = tuple(dt.datetime(1998, month, day) for month in (3, 6, 9) for day in (1, 10, 20))
DAYS_SQL = ", ".join(f"TIMESTAMP '{d:%Y-%m-%d} 00:00:00'" for d in DAYS)


@query(
    "a02_filtered_scan",
    f"SELECT l_orderkey, l_suppkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate IN ({DAYS_SQL})",
)
def filtered_scan(t: Tables):
    wanted = [F.lit(d).cast("timestamp_ntz") for d in DAYS]
    return tb.days_scan(
        t.lineitem, "l_shipdate", wanted, ["l_orderkey", "l_suppkey", "l_quantity", "l_shipdate"]
    )


@query("a03_latest_date", "SELECT max(l_shipdate) AS last_date FROM lineitem")
def latest_date(t: Tables):
    return tb.last_date(t.lineitem, "l_shipdate")


@query(
    "a04_cached_span",
    "SELECT o_custkey % 10 AS cell_id, DATE '1995-01-01' AS start, greatest(coalesce(CASE WHEN max(o_orderdate) FILTER (o_orderkey % 3 = 0) IS NOT NULL THEN "
    "least(CAST(max(o_orderdate) AS DATE), CAST(max(o_orderdate) FILTER (o_orderkey % 3 = 0) AS DATE)) END, DATE '2001-07-15'), DATE '2001-07-15') AS \"end\" FROM orders GROUP BY 1",
)
def cached_span(t: Tables):
    ends = t.orders.groupBy((F.col("o_custkey") % 10).alias("cell_id")).agg(
        F.to_date(F.max("o_orderdate")).alias("a"),
        F.to_date(F.max(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")))).alias("b"),
    )
    span = tb.cached_span(
        [F.col("a"), F.col("b")],
        F.lit("1995-01-01").cast("date"),
        F.lit("2001-07-15").cast("date"),
    )
    return ends.select("cell_id", span["start"].alias("start"), span["end"].alias("end"))


CASE_TEXT = {
    "id": "CASE WHEN o_orderkey % 50 = 0 THEN 'a b' ELSE concat('c', CAST(o_orderkey - o_orderkey % 2 * (CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END) AS STRING)) END",
    "date": "CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING)) END",
    "time": "CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 8 = 1 THEN '25:00' ELSE concat(CAST(10 + o_orderkey % 10 AS STRING), ':30') END",
    "lat": "CASE WHEN o_orderkey % 6 = 0 THEN concat('46,', CAST(o_orderkey % 1000 AS STRING)) WHEN o_orderkey % 6 = 1 THEN '146.5' ELSE concat('46.', CAST(o_orderkey % 1000 AS STRING)) END",
    "lon": "concat('11.', CAST(o_custkey AS STRING))",
    "uncertainty_m": "CASE WHEN o_orderkey % 30 = 0 THEN '-5' ELSE CAST(o_orderkey % 2000 AS STRING) END",
    "coord_source": "CASE WHEN o_orderkey % 40 = 0 THEN 'guess' WHEN o_orderkey % 2 = 0 THEN 'map' ELSE ' report ' END",
    "place": "CASE WHEN o_orderkey % 60 = 0 THEN ' ' ELSE o_orderpriority END",
    "municipality": "o_orderstatus",
    "area_ha": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_totalprice AS STRING) END",
    "cause": "CASE WHEN o_orderkey % 20 = 0 THEN 'arson' WHEN o_orderkey % 3 = 0 THEN 'human' ELSE 'lightning' END",
    "source": "'record'",
    "notes": "''",
}
CASE_SQL = (
    "t AS (SELECT o_orderkey AS line, "
    + ", ".join(f"{v} AS \"{k}\"" for k, v in CASE_TEXT.items()).replace("AS STRING", "AS VARCHAR")
    + " FROM orders), p AS (SELECT line, id, coalesce(CAST(try_strptime(\"date\", '%d/%m/%Y') AS DATE), TRY_CAST(\"date\" AS DATE)) AS date, "
    "TRY_CAST(replace(lat, ',', '.') AS DOUBLE) AS lat, TRY_CAST(nullif(area_ha, '') AS DOUBLE) AS area_ha, trim(coord_source) AS cs, cause, nullif(trim(place), '') AS place, \"time\" AS tm, TRY_CAST(uncertainty_m AS DOUBLE) AS um, "
    "count(*) OVER (PARTITION BY id) AS copies FROM t), e AS (SELECT *, list_filter(["
    "CASE WHEN contains(id, ' ') THEN 'id' END, CASE WHEN date IS NULL THEN 'date' END, CASE WHEN tm = '25:00' THEN 'time' END, CASE WHEN lat > 90 THEN 'lat' END, "
    "CASE WHEN um < 0 THEN 'uncertainty_m' END, CASE WHEN cs = 'guess' THEN 'coord_source' END, CASE WHEN place IS NULL THEN 'place' END, CASE WHEN cause = 'arson' THEN 'cause' END, "
    "CASE WHEN copies > 1 THEN 'repeated id' END], lambda x: x IS NOT NULL) AS errors FROM p)"
)


def _cases(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey AS line", *(f"{v} AS `{k}`" for k, v in CASE_TEXT.items())
    )


@query(
    "a05_validated_cases",
    f"WITH {CASE_SQL} SELECT line, id, date, lat, area_ha, cause FROM e WHERE len(errors) = 0",
)
def validated_cases(t: Tables):
    good, _ = rc.split_cases(rc.mark_repeated(rc.parse_cases(_cases(t))))
    return good.select("line", "id", "date", "lat", "area_ha", "cause")


@query(
    "a05_quarantined_cases",
    f"WITH {CASE_SQL} SELECT line, array_to_string(errors, ', ') AS fields FROM e WHERE len(errors) > 0",
)
def quarantined_cases(t: Tables):
    _, bad = rc.split_cases(rc.mark_repeated(rc.parse_cases(_cases(t))))
    return bad.select("line", F.array_join("errors", ", ").alias("fields"))


TRACKS_SQL = (
    "k AS (SELECT l_suppkey, l_shipdate, l_tax, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_partkey) - 1 AS n FROM lineitem), "
    "c AS (SELECT *, n // 30 AS sample, n % 30 AS step FROM k), w AS (SELECT l_suppkey, sample FROM c GROUP BY 1, 2 HAVING count(*) = 30)"
)


def _track_rows(t: Tables):
    """Lineitem of a supplier in order, cut into runs of thirty, the last of which may be short."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    keyed = t.lineitem.withColumns({"_order": order, "_one": F.lit(1).cast("bigint")})
    numbered = running_sums(keyed, ["l_suppkey"], "_order", ["_one"])
    place = F.col("cum__one") - 1
    return numbered.withColumns({"sample": F.floor(place / 30), "step": place % 30})


def _track_key():
    return [F.lit("supplier"), F.col("l_suppkey"), F.col("sample")]


def _whole_tracks(rows):
    """The rows of whole tracks; `a06_ragged_tracks` names the others, which the operator refuses."""
    ragged = rc.ragged_tracks(rows, _track_key(), 30).select("track_id")
    return rows.withColumn("track_id", F.concat_ws("-", *_track_key())).join(ragged, "track_id", "left_anti").drop("track_id")


def _tracks(rows):
    return rc.target_days(
        rows,
        _track_key(),
        "step",
        30,
        29,
        "l_quantity",
        (7, 30),
        {"tax": F.col("l_tax"), "time": F.col("l_shipdate")},
    )


@query(
    "a06_fixed_length_tracks",
    f"WITH {TRACKS_SQL} SELECT concat_ws('-', 'supplier', l_suppkey, sample) AS track_id, sum(l_quantity) FILTER (step > 22) AS precip_cum7_mm, sum(l_quantity) AS precip_cum30_mm, "
    "max(l_tax) FILTER (step = 29) AS tax, max(l_shipdate) FILTER (step = 29) AS time FROM c JOIN w USING (l_suppkey, sample) GROUP BY l_suppkey, sample",
)
def fixed_length_tracks(t: Tables):
    return _tracks(_whole_tracks(_track_rows(t)))


@query(
    "a06_ragged_tracks",
    f"WITH {TRACKS_SQL} SELECT concat_ws('-', 'supplier', l_suppkey, sample) AS track_id, count(*) AS days FROM c GROUP BY l_suppkey, sample HAVING count(*) <> 30",
)
def ragged_tracks(t: Tables):
    return rc.ragged_tracks(_track_rows(t), _track_key(), 30)


@query(
    "a07_labelled_union",
    f"WITH {TRACKS_SQL}, x AS (SELECT l_suppkey, sample, sum(l_quantity) AS precip_cum30_mm FROM c JOIN w USING (l_suppkey, sample) GROUP BY 1, 2) "
    "SELECT concat_ws('-', 'supplier', l_suppkey, sample) AS track_id, precip_cum30_mm, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS label FROM x",
)
def labelled_tracks(t: Tables):
    rows = _whole_tracks(_track_rows(t))
    even = F.col("l_suppkey") % 2 == 0
    both = rc.labelled_tracks(_tracks(rows.where(even)), _tracks(rows.where(~even)))
    return both.select("track_id", "precip_cum30_mm", "label")


@query(
    "a08_hourly_payload",
    "SELECT user_id AS place, strftime(ts, '%Y-%m-%dT%H:%M')::TIMESTAMP AS time, value AS temp, event_id * 1e0 AS wind FROM events",
)
def hourly_payload(t: Tables):
    hours = F.sort_array(
        F.collect_list(
            F.struct(
                "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), "value"
            )
        )
    )
    # a payload holds at most the hundred events of one block of ids
    block = F.floor(F.col("event_id") / 100)
    packed = t.events.groupBy("user_id", block).agg(hours.alias("h"))
    payload = F.to_json(
        F.struct(
            F.lit(46.0).alias("latitude"),
            F.lit(11.0).alias("longitude"),
            F.struct(
                F.transform("h", lambda r: r["time"]).alias("time"),
                F.transform("h", lambda r: r["value"]).alias("temp"),
                F.transform("h", lambda r: r["event_id"].cast("double")).alias("wind"),
            ).alias("hourly"),
        )
    )
    texts = packed.select(F.col("user_id").alias("place"), payload.alias("payload"))
    rows = pl.hourly_rows(texts, "payload", ["place"], ["temp", "wind"])
    return rows.select("place", "time", "temp", "wind")


@query(
    "a08_other_clocks",
    "WITH c AS (SELECT event_id, event_type, event_id % 3 = 0 AS odd FROM events) SELECT event_id, event_type FROM c WHERE odd",
)
def other_clocks(t: Tables):
    """A third of the requests' payloads lack the hour the others start with."""
    clock = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("01:00"))).otherwise(
        F.array(F.lit("00:00"), F.lit("01:00"))
    )
    payload = F.to_json(F.struct(F.struct(clock.alias("time")).alias("hourly")))
    texts = t.events.select("event_id", "event_type", payload.alias("payload"))
    return pl.other_clocks(texts, "payload", ["event_id"], "event_type")


@query(
    "a09_lattice_table",
    "WITH p AS (SELECT DISTINCT l_quantity AS lat, l_discount AS lon FROM lineitem) SELECT lat, lon, dense_rank() OVER (ORDER BY lat DESC) * (SELECT count(DISTINCT lon) FROM p) - (SELECT count(DISTINCT lon) FROM p) + dense_rank() OVER (ORDER BY lon) - 1 AS era5_id FROM p",
)
def lattice_table(t: Tables):
    nodes = t.lineitem.select(
        F.col("l_quantity").alias("lat"), F.col("l_discount").alias("lon")
    ).distinct()
    return pl.lattice_ids(nodes, "lat", "lon").select("lat", "lon", "era5_id")


@query(
    "a09_joined_variables",
    f"WITH {WITH_DAILY} SELECT era5_id, date, temp_mean, precip_sum FROM daily",
)
def joined_variables(t: Tables):
    days = t.daily()
    return pl.join_variables(
        days.select("era5_id", "date", "temp_mean"),
        days.select("era5_id", "date", "precip_sum"),
        ["era5_id", "date"],
    )


@query(
    "a10_stacked_bands",
    "SELECT vec_id, CAST(h AS INT) AS hour, CAST(embedding[h * 2 + 1] AS DOUBLE) AS t2m, CAST(embedding[h * 2 + 2] AS DOUBLE) AS d2m FROM embeddings, range(0, 32) r(h)",
)
def stacked_bands(t: Tables):
    rows = t.embeddings.withColumn("bands", F.col("embedding").cast("array<double>"))
    return pl.stacked_bands(rows, "bands", ["vec_id"], ["t2m", "d2m"], 32)


@query(
    "a11_band_names",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ndvi' ELSE 'lst' END END AS name, "
    "CASE WHEN o_orderkey % 5 > 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders",
)
def band_names(t: Tables):
    key = F.col("o_orderkey")
    name = F.when(key % 2 == 0, "ndvi").otherwise("lst")
    text = pl.band_name(name, F.col("o_orderdate"))
    spoiled = F.when(key % 5 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    parsed, month = pl.parse_band_name(spoiled, ["ndvi", "lst"])
    return t.orders.select("o_orderkey", parsed.alias("name"), month.alias("month"))


@query(
    "a11_checked_band_names",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ndvi' ELSE 'lst' END AS name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders",
)
def checked_band_names(t: Tables):
    """Every name is well formed here, so the check lets all of them pass."""
    text = pl.band_name(F.when(F.col("o_orderkey") % 2 == 0, "ndvi").otherwise("lst"), F.col("o_orderdate"))
    parsed, month = pl.checked_band_name(text, ["ndvi", "lst"])
    return t.orders.select("o_orderkey", parsed.alias("name"), month.alias("month"))


@query(
    "a12_cell_bands",
    f"WITH {WITH_GRID}, w AS (SELECT l_suppkey AS cell_id, sum(l_quantity) AS ndvi, count(*) * 1e0 AS lst FROM lineitem GROUP BY 1), g AS (SELECT cell_id, ndvi, lst FROM grid LEFT JOIN w USING (cell_id)) "
    "SELECT cell_id, band, value FROM (SELECT cell_id, 'ndvi' AS band, ndvi AS value FROM g UNION ALL SELECT cell_id, 'lst', lst FROM g)",
)
def cell_bands(t: Tables):
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("cell_id")).agg(
        F.sum("l_quantity").alias("ndvi"), (F.count("*") * F.lit(1.0)).alias("lst")
    )
    long = pl.long_bands(sums, "cell_id", ["ndvi", "lst"])
    wide = pl.wide_bands(long, "cell_id", "band", "value", ["ndvi", "lst"])
    dense = pl.dense_grid(wide, "cell_id", t.customer.count())
    return pl.long_bands(dense, "cell_id", ["ndvi", "lst"])


@query(
    "a14_json_records",
    f"WITH {WITH_CELL_DAYS} SELECT CAST(date AS VARCHAR) AS date, count(*) AS cells, round(avg(raw), 9) AS mean, round(max(raw), 9) AS max FROM cell_days GROUP BY date",
)
def json_records(t: Tables):
    """A record a day as JSON lines, written and read back."""
    days = t.cell_days().groupBy("date").agg(F.count("*").alias("cells"), F.struct(F.avg("raw").alias("mean"), F.max("raw").alias("max")).alias("probability"))
    path = fresh_path(t.spark, "records")
    tb.write_json(days, path)
    back = t.spark.read.schema("date string, cells bigint, probability struct<mean double, max double>").json(path)
    return back.select("date", "cells", F.round("probability.mean", 9).alias("mean"), F.round("probability.max", 9).alias("max"))


@query(
    "a14_written_days",
    f"WITH {WITH_CELL_DAYS} SELECT cell_id, raw, CAST(year(date) AS INT) AS year FROM cell_days",
)
def written_days(t: Tables):
    rows = t.cell_days().select("cell_id", "raw", F.year("date").alias("year"))
    path = fresh_path(t.spark, "risk")
    tb.write_by_day(rows, path, date="year")
    return t.spark.read.schema("cell_id BIGINT, raw DOUBLE, year INT").parquet(path)


@query("a14_written_csv", f"WITH {WITH_GRID} SELECT cell_id, elevation, c_mktsegment FROM grid")
def written_csv(t: Tables):
    path = fresh_path(t.spark, "csv")
    tb.write_csv(t.grid().select("cell_id", "elevation", "c_mktsegment"), path)
    return t.spark.read.schema("cell_id BIGINT, elevation DOUBLE, c_mktsegment STRING").option(
        "header", True
    ).csv(path)


# the contract of the daily backbone, as categories with defaults and overrides
CATEGORIES = {
    "identity": {
        "role": "key",
        "columns": {"era5_id": {"dtype": "bigint"}, "date": {"dtype": "date"}},
    },
    "meteo": {
        "temporal": "dynamic",
        "dtype": "double",
        "columns": {
            "temp_mean": {"min": 12.0, "max": 30.0},
            "precip_sum": {"min": 0.0, "max": 250.0},
            "wind_speed_mean": {"min": 0.0},
            "wind_speed_max": {"min": 0.0, "dtype": "float"},
            "rh_mean": {"min": 0.0, "max": 100.0},
            "cape_max": {"optional": True},
            "snow": {},
        },
    },
}


@query(
    "a16_registry",
    "WITH u AS (SELECT DISTINCT l_returnflag AS feature FROM lineitem) SELECT feature, CASE WHEN feature = 'A' THEN 'meteo' ELSE 'landcover' END AS category, CASE WHEN feature = 'A' THEN 'dynamic' ELSE 'static' END AS temporal, "
    "CASE WHEN feature = 'N' THEN 'double' ELSE 'float' END AS dtype, feature = 'R' AS nullable FROM u",
)
def registry(t: Tables):
    flags = sorted(r[0] for r in t.lineitem.select("l_returnflag").distinct().collect())
    categories = {
        "meteo": {
            "temporal": "dynamic",
            "dtype": "float",
            "columns": {f: {} for f in flags if f == "A"},
        },
        "landcover": {
            "temporal": "static",
            "dtype": "float",
            "columns": {
                f: ({"dtype": "double"} if f == "N" else {"nullable": True})
                for f in flags
                if f != "A"
            },
        },
    }
    return rg.registry_frame(t.spark, categories).select(
        F.col("name").alias("feature"), "category", "temporal", "dtype", "nullable"
    )


@query(
    "a17_contract_report",
    f"WITH {WITH_DAILY}, s AS (SELECT count(*) AS n, count(*) FILTER (temp_mean < 12 OR temp_mean > 30) AS tb, min(temp_mean) AS tl, max(temp_mean) AS th, count(*) FILTER (precip_sum > 250) AS pb, min(precip_sum) AS pl, max(precip_sum) AS ph FROM daily) "
    # the report lists breaks only, so a rule nothing breaks has no row on either side
    "SELECT * FROM (SELECT 'temp_mean' AS \"column\", 'bounds' AS rule, tb AS bad_rows, round(tl, 9) AS observed_min, round(th, 9) AS observed_max FROM s UNION ALL SELECT 'precip_sum', 'bounds', pb, pl, ph FROM s "
    "UNION ALL SELECT 'snow', 'missing', n, NULL, NULL FROM s UNION ALL SELECT 'wind_speed_max', 'dtype', n, NULL, NULL FROM s "
    "UNION ALL SELECT c, 'undeclared', n, NULL, NULL FROM s, (SELECT unnest(['n_rows', 'temp_min', 'temp_max']) AS c)) WHERE bad_rows > 0",
)
def contract_report(t: Tables):
    report = rg.validate_frame(t.daily(), rg.flatten(CATEGORIES))
    return report.withColumns(
        {c: F.round(c, 9) for c in ("observed_min", "observed_max")}
    )


def _features(t: Tables):
    """Orders as tagged map features: lines, points and polygons."""
    key = F.col("o_orderkey")
    x, y = F.col("o_custkey") * 1.0, (key % 1000) * 1.0
    kind = F.when(key % 3 == 0, "line").when(key % 3 == 1, "point").otherwise("polygon")
    highway = (
        F.when(key % 12 == 0, "primary_link")
        .when(key % 12 == 3, "track")
        .when(key % 12 == 6, "path")
    )
    tourism = F.when(key % 5 == 0, "hotel").when(key % 5 == 1, "alpine_hut")
    tags = F.map_filter(
        F.create_map(
            F.lit("highway"), highway, F.lit("tourism"), tourism,
            F.lit("amenity"), F.when(key % 7 == 0, "parking"),
        ),
        lambda k, v: v.isNotNull(),
    )
    corners = F.array(
        *(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (4, 0), (4, 2), (0, 2)))
    )
    return t.orders.select(
        key.alias("feature_id"), kind.alias("kind"), tags.alias("tags"), corners.alias("vertices")
    )


@query(
    "a19_road_layers",
    "SELECT o_orderkey AS feature_id, 'roads' AS layer FROM orders WHERE o_orderkey % 12 IN (0, 3) UNION ALL SELECT o_orderkey, 'major' FROM orders WHERE o_orderkey % 12 = 0",
)
def road_layers(t: Tables):
    rows = _features(t)
    return labelled_union(
        {
            "roads": ft.lines(rows, "roads").select("feature_id"),
            "major": ft.major_roads(rows).select("feature_id"),
        },
        "layer",
    )


@query(
    "a19_poi_points",
    "SELECT o_orderkey AS feature_id, o_custkey + CASE WHEN o_orderkey % 3 = 2 THEN 2e0 ELSE 0e0 END AS x, o_orderkey % 1000 + CASE WHEN o_orderkey % 3 = 2 THEN 1e0 ELSE 0e0 END AS y, "
    "o_orderkey % 5 = 1 OR o_orderkey % 7 = 0 AS recreation, o_orderkey % 5 IN (0, 1) AS lodging FROM orders WHERE o_orderkey % 3 > 0 AND (o_orderkey % 5 IN (0, 1) OR o_orderkey % 7 = 0)",
)
def poi_points(t: Tables):
    kinds = ft.poi_kinds()
    return ft.poi_points(_features(t)).select(
        "feature_id",
        F.round("x", 6).alias("x"),
        F.round("y", 6).alias("y"),
        kinds["recreational_density"].alias("recreation"),
        kinds["lodging_density"].alias("lodging"),
    )


@query(
    "a20_backbone_orography",
    f"WITH {WITH_GRID} SELECT cell_id, round(elevation * 98e-1 / 9.80665e0, 6) AS height FROM grid",
)
def backbone_orography(t: Tables):
    grid = t.grid()
    geopotential = grid.select("cell_id", (F.col("elevation") * 9.8).alias("z"))
    out = pl.orography(grid.select("cell_id"), geopotential, ["cell_id"], "z")
    return out.withColumn("height", F.round("height", 6))


@query(
    "a21_later_cases",
    f"WITH {WITH_FIRES} SELECT 'record-' || fire_id AS id, ignition_date AS date, start_hour AS hour, coalesce(CASE WHEN fire_id % 4 > 0 THEN 'p' || (fire_id % 10) END, 'fire ' || fire_id) AS place, area_ha, "
    "CASE WHEN cause = 10 THEN 'lightning' ELSE 'unknown' END AS cause FROM fires WHERE year > 1999",
)
def later_cases(t: Tables):
    key = F.col("fire_id")
    fires = t.fires().withColumn(
        "loc", F.when(key % 4 > 0, F.concat(F.lit("p"), (key % 10).cast("string")))
    )
    lon, lat = geo.from_utm(
        F.lit(650000.0) + F.col("cell_id"), F.lit(5100000.0) + F.col("cell_id")
    )
    out = ev.later_cases(fires, 1999, lon, lat)
    return out.select("id", "date", "hour", "place", "area_ha", "cause")


@query(
    "a22_static_block",
    f"WITH {WITH_GRID}, b AS (SELECT l_suppkey AS cell_id, CASE WHEN l_linenumber % 2 = 0 THEN 'slope' ELSE 'height' END AS band, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2) "
    "SELECT cell_id, max(value) FILTER (band = 'slope') AS slope, max(value) FILTER (band = 'height') AS height FROM b WHERE cell_id IN (SELECT cell_id FROM grid WHERE is_active) GROUP BY cell_id",
)
def static_block(t: Tables):
    band = F.when(F.col("l_linenumber") % 2 == 0, "slope").otherwise("height").alias("band")
    long = t.lineitem.groupBy(F.col("l_suppkey").alias("cell_id"), band).agg(
        F.max("l_extendedprice").alias("value")
    )
    active = t.grid().where("is_active")
    return pl.static_block(long, active, ["cell_id"], ["slope", "height"])
