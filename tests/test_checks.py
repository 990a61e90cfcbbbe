"""Registered queries beside their DuckDB twins on the smallest tables, a few per section."""

import math
from pathlib import Path

import duckdb
import pytest

from gridrisk.catalog import load

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, CHECKS = load()

SAMPLE = (
    "a05_validated_cases a08_hourly_payload a17_contract_report b04_timestamp_assembly "
    "b15_calendar_features b24_lapse_correction c05_polygon_cells c07_ignition_points "
    "c13_line_distance c16_history_density c21_connected_episodes c26_terrain "
    "d04_preceding_composite d06_interpolation d12_near_other_events d17_quantile_map "
    "d19_training_table d22_superseded_days e01_daily_aggregates e06_rung_statistics "
    "e14_collapse_to_largest e17_global_ladder e22_poisson_p e23_percentile_summary "
    "f03_days_since f06_capped_forward_fill f07_percentile_rank f12_fire_weather "
    "g01_sequential_id g04_precision_at_top h02_keep_first i01_uniform_negatives "
    "i06_spatial_folds i07_scores i10_reliability i14_window_shift i30_event_verification "
    "j02_point_query"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    return a == b


def test_every_check_has_its_query():
    assert set(CHECKS) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(FOLDER))
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    theirs = [tuple(dict(zip(names, row))[c] for c in sorted(names)) for row in cursor.fetchall()]
    ours = [tuple(row[c] for c in sorted(names)) for row in frame.collect()]
    assert len(ours) == len(theirs)

    def order(row):
        # floats by what survives the last digit, so that near-equal rows meet
        return tuple((v is None, str(round(v, 3) + 0.0) if isinstance(v, float) else str(v)) for v in row)

    pairs = zip(sorted(ours, key=order), sorted(theirs, key=order))
    off = [(a, b) for a, b in pairs if not all(_same(x, y) for x, y in zip(a, b))]
    assert not off, off[:3]
