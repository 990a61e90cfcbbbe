"""How the given tables stand in for the inputs of the operators.

The text of each stand-in is shared by both engines, since it is not what the checks are about.
Literals carry an exponent so that both read them as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridrisk.sources.tables import scan

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# events as an hourly series: a user is a cell
HOURLY = (
    "user_id AS cell_id",
    "ts",
    "5e0 + value % 4e1 AS temp_c",
    "5e0 + value % 4e1 - event_id % 13 AS dewpoint_c",
    "9e2 + event_id % 150 AS pres_hpa",
    "CAST(event_id % 21 - 10 AS DOUBLE) AS u10",
    "CAST(event_id % 17 - 8 AS DOUBLE) AS v10",
    "CAST(greatest(event_id % 11 - 7, 0) AS DOUBLE) AS precip_mm",
    "event_id",
)

# lineitem as a daily backbone of eight cells, four columns by two rows, a few days missing
DAILY_FROM = "lineitem"
DAILY_KEYS = ("l_suppkey % 8 AS era5_id", "CAST(l_shipdate AS DATE) AS date")
DAILY_VALUES = (
    "sum(CAST(round(l_extendedprice * 1e2) AS BIGINT)) / (count(*) * 250000) AS temp_mean",
    "sum(CAST(round(l_tax * 1e2) AS BIGINT)) * 12 / count(*) AS rh_mean",
    "CAST(greatest(sum(l_quantity) - 6e1, 0e0) AS DOUBLE) AS precip_sum",
    "sum(CAST(l_quantity AS BIGINT)) / (count(*) * 10) AS wind_speed_mean",
    "max(l_quantity) / 8e0 AS wind_speed_max",
    "min(l_extendedprice) / 25e2 AS temp_min",
    "max(l_extendedprice) / 25e2 AS temp_max",
    "count(*) AS n_rows",
)

# orders as the record of events: a customer is the cell of the ignition
FIRES = (
    "o_orderkey AS fire_id",
    "o_custkey AS cell_id",
    "o_totalprice / 1e3 AS area_ha",
    "CAST(o_orderdate AS DATE) AS ignition_date",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL "
    "ELSE CAST(o_orderdate + (o_orderkey % 5 - 1) * INTERVAL '1' DAY AS DATE) END AS end_date_raw",
    "CAST(o_orderkey % 24 AS INT) AS start_hour",
    "CAST(o_orderkey % 12 AS INT) AS cause",
    "year(o_orderdate) AS year",
)

# customers as grid cells in row-major order, forty to a row of 500 m cells
N_COLS = 40
RES = 500
XMIN = 600000
YMAX = 5200000
GRID = (
    "c_custkey AS cell_id",
    "CAST(c_custkey % 40 AS INT) AS x_index",
    "CAST((c_custkey - c_custkey % 40) / 40 AS INT) AS y_index",
    "6e5 + (c_custkey % 40 + 5e-1) * 5e2 AS x",
    "52e5 - ((c_custkey - c_custkey % 40) / 40 + 5e-1) * 5e2 AS y",
    "c_nationkey % 5 <> 0 AS is_active",
    "2e2 + c_acctbal / 5e0 AS elevation",
    "c_nationkey",
    "c_mktsegment",
)

# lineitem as scored rows: a label and a score with many ties
SCORES = (
    "l_orderkey * 8 + l_linenumber AS row_id",
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
    "floor((l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN 11e-1 ELSE 1e0 END)) / 12e1) / 1e3"
    " AS score",
    "CAST(year(l_shipdate) AS INT) AS year",
    "CAST(l_shipdate AS DATE) AS date",
    "l_suppkey AS cell_id",
)

# lineitem as scored cell-days: one row per cell and day, cells laid out forty to a row
CELL_DAYS_KEYS = ("l_suppkey AS cell_id", "CAST(l_shipdate AS DATE) AS date")
CELL_DAYS_VALUES = (
    "max(floor(l_extendedprice / 11e1) / 1e3) AS raw",
    "count(*) AS n",
)


def select(columns, source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


def grouped(keys, values, source: str) -> str:
    names = ", ".join(key.rsplit(" AS ", 1)[0] for key in keys)
    return f"SELECT {', '.join((*keys, *values))} FROM {source} GROUP BY {names}"


HOURLY_SQL = select(HOURLY, "events")
DAILY_SQL = grouped(DAILY_KEYS, DAILY_VALUES, DAILY_FROM)
FIRES_SQL = select(FIRES, "orders")
GRID_SQL = select(GRID, "customer")
SCORES_SQL = select(SCORES, "lineitem")
CELL_DAYS_SQL = grouped(CELL_DAYS_KEYS, CELL_DAYS_VALUES, "lineitem")

WITH_HOURLY = f"hourly AS ({HOURLY_SQL})"
WITH_DAILY = f"daily AS ({DAILY_SQL})"
WITH_FIRES = f"fires AS ({FIRES_SQL})"
WITH_GRID = f"grid AS ({GRID_SQL})"
WITH_SCORES = f"scores AS ({SCORES_SQL})"
WITH_CELL_DAYS = f"cell_days AS ({CELL_DAYS_SQL})"


class Tables:
    """The given tables under one folder, as attributes, and the stand-ins over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return scan(self.spark, f"{self.folder}/{name}.parquet", SCHEMAS[name])

    def hourly(self) -> DataFrame:
        return self.events.selectExpr(*HOURLY)

    def daily(self) -> DataFrame:
        return _aggregate(self.lineitem, DAILY_KEYS, DAILY_VALUES)

    def fires(self) -> DataFrame:
        return self.orders.selectExpr(*FIRES)

    def grid(self) -> DataFrame:
        return self.customer.selectExpr(*GRID)

    def scores(self) -> DataFrame:
        return self.lineitem.selectExpr(*SCORES)

    def cell_days(self) -> DataFrame:
        return _aggregate(self.lineitem, CELL_DAYS_KEYS, CELL_DAYS_VALUES)


def _aggregate(source: DataFrame, keys, values) -> DataFrame:
    from pyspark.sql import functions as F

    return source.groupBy(*(F.expr(key) for key in keys)).agg(*(F.expr(v) for v in values))
