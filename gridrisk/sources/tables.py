"""Columnar scans, probes and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Parquet under a declared schema, so no footer is read to infer one."""
    return spark.read.schema(schema).parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in every input; Spark counts it, sums it and sorts it last otherwise."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *(
            F.when(~F.isnan(name), F.col(name)).alias(name) if name in floating else F.col(name)
            for name in df.columns
        )
    )


def days_scan(df: DataFrame, date: str, days: Iterable, columns: Sequence[str]) -> DataFrame:
    """Only the wanted days and columns; both reach the Parquet reader."""
    wanted = list(days)
    return df.where(F.col(date).isin(wanted)).select(*columns)


def last_date(df: DataFrame, date: str, out: str = "last_date") -> DataFrame:
    """The latest day of a table, NULL for an empty one."""
    return df.agg(F.max(date).alias(out))


def cached_span(last_dates: Sequence[Column], record_start: Column, record_end: Column) -> Column:
    """How far the cached tables reach together: never short of the record's own end.

    A table that is missing (NULL) leaves only the record.
    """
    known = F.lit(True)
    for value in last_dates:
        known = known & value.isNotNull()
    reached = F.when(known, F.least(*last_dates) if len(last_dates) > 1 else last_dates[0])
    end = F.greatest(F.coalesce(reached, record_end), record_end)
    return F.struct(record_start.alias("start"), end.alias("end"))


def write_by_day(df: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> None:
    """One folder per day; rows of a day are spread over several files when they are many."""
    df.write.mode(mode).partitionBy(date).option("maxRecordsPerFile", 5_000_000).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
