"""Run registered queries beside their DuckDB twins: python tools/compare.py SF [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from gridrisk.catalog import load
from gridrisk.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "TINYINT": "int8", "SMALLINT": "int16", "INTEGER": "int32", "BIGINT": "int64",
    "FLOAT": "float32", "DOUBLE": "float64", "BOOLEAN": "bool", "VARCHAR": "string",
    "DATE": "date", "TIMESTAMP": "ts",
}
SPARK_KINDS = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32",
    "double": "float64", "boolean": "bool", "string": "string", "date": "date",
    "timestamp_ntz": "ts", "timestamp": "ts",
}


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if hasattr(value, "asDict"):
        return tuple(canonical(v) for v in value)
    if isinstance(value, list):
        return tuple(canonical(v) for v in value)
    return value


def order_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(spark, con, run, sql, folder):
    started = time.time()
    frame = run(spark, folder)
    rows = frame.collect()
    took = time.time() - started
    columns = frame.columns
    if sql is None:
        return f"rows-only {len(rows):6d} {took:6.2f}s", bool(columns) and len(rows) > 0
    started = time.time()
    cursor = con.execute(sql)
    theirs = cursor.fetchall()
    duck = time.time() - started
    names = [d[0] for d in cursor.description]
    note = f"rows {len(rows):6d}/{len(theirs):6d} {took:6.2f}s duck {duck:5.2f}s"
    if sorted(columns) != sorted(names):
        return f"{note} COLUMNS {sorted(columns)} vs {sorted(names)}", False
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    ours = {f.name: SPARK_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema}
    off = {n: (ours[n], kinds[n]) for n in ours if ours[n] != kinds[n]}
    order = sorted(columns)
    left = sorted((tuple(canonical(r[columns.index(c)]) for c in order) for r in rows), key=order_key)
    right = sorted((tuple(canonical(r[names.index(c)]) for c in order) for r in theirs), key=order_key)
    if off:
        note += f" TYPES {off}"
    if len(left) != len(right):
        only_l = list(set(left) - set(right))[:3]
        only_r = list(set(right) - set(left))[:3]
        return f"{note} COUNT\n   cols {order}\n   spark only {only_l}\n   duck only {only_r}", False
    if left == right:
        if not left:
            note += " EMPTY"
        return note, not off
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    loose = [(a, b) for a, b in bad if not all(close(x, y) for x, y in zip(a, b))]
    kind = "NEAR" if not loose else "VALUES"
    sample = (loose or bad)[:3]
    return f"{note} {kind} {len(bad)} differ\n   cols {order}\n   " + "\n   ".join(map(str, sample)), False


def main():
    folder = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    queries, checks = load()
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    failed = []
    total = time.time()
    for name in sorted(queries):
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            note, good = compare(spark, con, queries[name], checks.get(name), folder)
        except Exception as error:  # noqa: BLE001
            note, good = f"ERROR {type(error).__name__}: {str(error)[:900]}", False
        print("ok  " if good else "FAIL", f"{name:42s}", note, flush=True)
        if not good:
            failed.append(name)
    print(f"{len(failed)} failed of {len(queries)}: {failed}; {time.time() - total:.0f}s")
    spark.stop()


if __name__ == "__main__":
    main()
