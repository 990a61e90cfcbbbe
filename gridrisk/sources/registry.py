"""The declared columns of the training table, and a table checked against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.operators.landcover import CORINE_CODES, N_CLASSES

ROW = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("temporal", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("optional", T.BooleanType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)


def flatten(categories: Mapping[str, Mapping]) -> list[dict]:
    """Category defaults under column overrides; duplicates and undated features are refused."""
    rows, seen = [], set()
    for category, block in categories.items():
        defaults = {k: v for k, v in block.items() if k != "columns"}
        for name, overrides in block["columns"].items():
            spec = {**defaults, **(overrides or {})}
            role = spec.get("role", "feature")
            if name in seen:
                raise ValueError(f"{name} is declared more than once")
            if role == "feature" and spec.get("temporal") is None:
                raise ValueError(f"the feature {name} has no temporal")
            seen.add(name)
            rows.append(
                {
                    "name": name,
                    "category": category,
                    "role": role,
                    "temporal": spec.get("temporal"),
                    "dtype": spec["dtype"],
                    "nullable": bool(spec.get("nullable", False)),
                    "optional": bool(spec.get("optional", False)),
                    "low": None if spec.get("min") is None else float(spec["min"]),
                    "high": None if spec.get("max") is None else float(spec["max"]),
                }
            )
    return rows


def resolve(value, settings: Mapping):
    """Follow a 'config:a.b' reference into the settings, or pass the value on."""
    if not isinstance(value, str) or not value.startswith("config:"):
        return value
    node = settings
    for part in value.removeprefix("config:").split("."):
        node = node[part]
    return node


def registry_frame(spark: SparkSession, categories: Mapping[str, Mapping]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in ROW) for r in flatten(categories)], ROW)


def table_schema(rows: Sequence[Mapping]) -> T.StructType:
    kinds = {
        "tinyint": T.ByteType(),
        "smallint": T.ShortType(),
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "float": T.FloatType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "string": T.StringType(),
        "date": T.DateType(),
    }
    return T.StructType([T.StructField(r["name"], kinds[r["dtype"]], r["nullable"]) for r in rows])


def landcover_columns() -> list[str]:
    """Names of the 44 class shares and their level-2 and level-1 sums, from the code list."""
    names = [f"CLC_{code}" for code in range(1, N_CLASSES + 1)]
    for level in (2, 1):
        parents = sorted({code // 10 ** (3 - level) for code in CORINE_CODES})
        names += [f"CLC_L{level}_{p}" for p in parents]
    return names


def validate_frame(df: DataFrame, rows: Sequence[Mapping], dtypes: bool = True) -> DataFrame:
    """Every break of the contract as (column, rule, bad_rows, observed_min, observed_max).

    Names and types are known from the schema; NULLs and bounds of all columns are counted in one
    aggregate pass.
    """
    declared = {r["name"]: r for r in rows}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    n = F.count("*")
    checks: list[tuple[str, str, Column, Column, Column]] = []
    nothing = F.lit(None).cast("double")
    for name in sorted(set(have) - set(declared)):
        checks.append((name, "undeclared", n, nothing, nothing))
    for name, spec in declared.items():
        if name not in have:
            if not spec["optional"]:
                checks.append((name, "missing", n, nothing, nothing))
            continue
        if dtypes and have[name] != spec["dtype"]:
            checks.append((name, "dtype", n, nothing, nothing))
        if not spec["nullable"]:
            checks.append((name, "null", F.count_if(F.col(name).isNull()), nothing, nothing))
        low, high = spec["low"], spec["high"]
        if low is not None or high is not None:
            outside = F.lit(False)
            if low is not None:
                outside = outside | (F.col(name) < low)
            if high is not None:
                outside = outside | (F.col(name) > high)
            value = F.col(name).cast("double")
            checks.append((name, "bounds", F.count_if(outside), F.min(value), F.max(value)))
    aggregates = []
    for i, (_, _, bad, lowest, highest) in enumerate(checks):
        aggregates += [bad.alias(f"b{i}"), F.first(lowest).alias(f"l{i}") if lowest is nothing else lowest.alias(f"l{i}")]
        aggregates += [F.first(highest).alias(f"h{i}") if highest is nothing else highest.alias(f"h{i}")]
    counted = df.agg(*aggregates)
    packed = F.array(
        *(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(rule).alias("rule"),
                F.col(f"b{i}").alias("bad_rows"),
                F.col(f"l{i}").alias("observed_min"),
                F.col(f"h{i}").alias("observed_max"),
            )
            for i, (name, rule, *_) in enumerate(checks)
        )
    )
    return counted.select(F.explode(packed).alias("c")).select("c.*").where(F.col("bad_rows") > 0)
