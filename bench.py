"""Headline queries on $BENCH_SF_DIR, one JSON line: seconds per query and their sum."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridrisk.catalog import load
from gridrisk.session import build_session

HEADLINE = (
    "e01_daily_aggregates",
    "f01_trailing_windows",
    "f03_days_since",
    "f06_capped_forward_fill",
    "f07_percentile_rank",
    "f12_fire_weather",
    "d01_many_to_one",
    "d04_preceding_composite",
    "d06_interpolation",
    "d11_event_cell_days",
    "d12_near_other_events",
    "d17_quantile_map",
    "d19_training_table",
    "e16_month_ladders",
    "e17_global_ladder",
    "e23_percentile_summary",
    "e35_monthly_composite",
    "c05_polygon_cells",
    "c15_kernel_density",
    "g01_sequential_id",
    "g04_precision_at_top",
    "i01_uniform_negatives",
    "i07_scores",
    "i10_reliability",
    "i30_event_verification",
    "j01_day_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    spark = build_session(cores, app="gridrisk-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # the first query would otherwise carry the start of the JVM's compiler
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
