"""The paths that only large or skewed inputs take, against brute force on small ones."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridrisk.functions import geometry as geo
from gridrisk.operators import episodes, fire_weather, ordering, sampling, spatial
from gridrisk.operators.grid import GridSpec

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def values(spark):
    pdf = pd.DataFrame({"g": np.where(RNG.random(4000) < 0.7, 0, RNG.integers(1, 5, 4000)), "v": np.round(RNG.normal(size=4000), 3)})
    pdf["id"] = np.arange(len(pdf))
    return pdf, spark.createDataFrame(pdf)


def test_sliced_rank_equals_pandas(values):
    pdf, df = values
    out = ordering.percentile_rank(df, ["g"], "v", "p", slice_rows=50).toPandas().sort_values("id")
    expected = pdf.groupby("g")["v"].rank(pct=True)
    assert np.allclose(out["p"].to_numpy(), expected.to_numpy())


def test_sliced_percentiles_equal_numpy(values):
    pdf, df = values
    out = ordering.exact_percentiles(df, ["g"], "v", rungs=101, slice_rows=50).toPandas()
    for g, part in out.groupby("g"):
        expected = np.percentile(pdf.loc[pdf["g"] == g, "v"], np.linspace(0, 100, 101))
        assert np.allclose(part.sort_values("rung")["value"], expected)
    probs = [0.0, 0.9, 0.999, 1.0]
    listed = ordering.exact_percentiles(df, (), "v", probs, slice_rows=50).toPandas().sort_values("rung")
    assert np.allclose(listed["value"], np.quantile(pdf["v"], probs))


def test_sliced_sums_and_maxima(values):
    pdf, df = values
    keyed = df.withColumn("o", F.struct("v", "id")).withColumn("one", F.lit(1).cast("bigint"))
    out = ordering.running_sums(keyed, (), "o", ["one"], slice_rows=100).toPandas().sort_values("cum_one")
    assert list(out["cum_one"]) == list(range(1, len(pdf) + 1))
    assert list(out["id"]) == list(pdf.sort_values(["v", "id"])["id"])
    points = df.groupBy("v").agg(F.max("id").alias("y"))
    top = ordering.running_max(points, (), "v", "y", "m", slice_rows=100).toPandas().sort_values("v")
    assert list(top["m"]) == list(np.maximum.accumulate(top["y"]))


def test_nearest_distance_of_remote_points(spark):
    lines = pd.DataFrame(RNG.uniform(0, 1000, (40, 4)), columns=["x1", "y1", "x2", "y2"])
    lines[["x2", "y2"]] = lines[["x1", "y1"]] + RNG.uniform(-150, 150, (40, 2))
    points = pd.DataFrame(RNG.uniform(-6000, 9000, (200, 2)), columns=["x", "y"])
    points["p"] = np.arange(len(points))
    out = spatial.nearest_distance(spark.createDataFrame(points), spark.createDataFrame(lines), 60.0, ["p"])
    got = out.toPandas().sort_values("p")["distance"].to_numpy()
    a, b = lines[["x1", "y1"]].to_numpy(), lines[["x2", "y2"]].to_numpy()
    q = points[["x", "y"]].to_numpy()[:, None, :]
    t = np.clip(((q - a) * (b - a)).sum(-1) / ((b - a) ** 2).sum(-1), 0, 1)
    expected = np.linalg.norm(q - (a + t[..., None] * (b - a)), axis=-1).min(1)
    assert np.allclose(got, expected)


def test_area_of_a_concave_polygon_by_cells(spark):
    corners = [(120, 130), (2890, 400), (1500, 1300), (2700, 2800), (300, 2500), (900, 1400)]
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners))
    shape = spark.range(1).withColumnRenamed("id", "geom_id").withColumn("sides", geo.edges(points))
    spec = GridSpec(0, 3000, 6, 6, 500)
    out = spatial.polygon_cells(shape, spec).toPandas().set_index("cell_id")["area"]
    grid = (np.arange(3000) + 0.5) * 1.0
    x, y = np.meshgrid(grid, grid)
    inside = np.zeros_like(x, dtype=bool)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        crosses = ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))
        inside ^= crosses
    cell = ((3000 - y) // 500).astype(int) * 6 + (x // 500).astype(int)
    expected = pd.Series(inside.ravel()).groupby(cell.ravel()).sum()
    gap = (out.reindex(expected.index).fillna(0) - expected).abs().max()
    assert gap < 1500 and out.sum() == pytest.approx(expected.sum(), rel=1e-3)
    # the same whichever way the grid is cut into bands
    assert set(out.index) >= set(expected[expected > 50].index)


def test_codes_do_not_depend_on_the_batches(spark):
    n_days, n_cells = 60, 7
    rows = [
        (c, dt.date(2003, 1, 1) + dt.timedelta(days=i), 10 + 8 * np.sin(i / 9 + c), 50 + 30 * np.cos(i / 5 + c), 12.0 + c, 15.0 if (i + c) % 11 == 0 else 0.0)
        for c in range(n_cells)
        for i in range(n_days)
    ]
    df = spark.createDataFrame([(c, d, float(t), float(h), w, r) for c, d, t, h, w, r in rows], "c int, d date, t double, h double, w double, r double")
    whole = fire_weather.fire_weather(df, "c", "d", "t", "h", "w", "r").toPandas().sort_values(["c", "d"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        cut = fire_weather.fire_weather(df, "c", "d", "t", "h", "w", "r").toPandas().sort_values(["c", "d"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.allclose(whole[["ffmc", "dmc", "dc", "fwi"]], cut[["ffmc", "dmc", "dc", "fwi"]])


def test_components_touch_over_corners_and_days(spark):
    cases = [(0, 0, 0), (0, 1, 1), (1, 1, 1), (2, 2, 2), (4, 2, 2), (0, 5, 5), (2, 5, 5)]
    df = spark.createDataFrame(cases, "day int, row int, col int")
    out = {(r.day, r.row, r.col): r.episode for r in episodes.number_episodes(episodes.label_components(df)).collect()}
    first = out[(0, 0, 0)]
    assert {out[c] for c in cases[:4]} == {first}
    assert len({out[c] for c in cases}) == 4


def test_a_long_chain_is_one_component(spark):
    df = spark.range(150).select(F.col("id").alias("day"), (F.col("id") * 1).alias("row"), F.lit(0).alias("col"))
    out = episodes.label_components(df)
    assert out.select("episode").distinct().count() == 1 and out.count() == 150


def test_negatives_avoid_exclusions_and_repeat(spark):
    cells = spark.createDataFrame([(c,) for c in range(10)], "cell_id int")
    blocked = spark.createDataFrame([(c, dt.date(2003, 1, 1 + d)) for c in range(5) for d in range(20)], "cell_id int, date date")
    first = sampling.sample_negatives(cells, blocked, 180, "2003-01-01", 30, 3)
    rows = {(r.cell_id, r.date) for r in first.collect()}
    assert len(rows) == 180
    assert not rows & {(r.cell_id, r.date) for r in blocked.collect()}
    again = {(r.cell_id, r.date) for r in sampling.sample_negatives(cells, blocked, 180, "2003-01-01", 30, 3).collect()}
    assert rows == again
    every = sampling.sample_negatives(cells, blocked, 200, "2003-01-01", 30, 3)
    assert every.select("cell_id", "date").distinct().count() == 200
    with pytest.raises(ValueError, match="only 200"):
        sampling.sample_negatives(cells, blocked, 201, "2003-01-01", 30, 3)


def test_null_groups_stay_at_any_slice_size(spark):
    from gridrisk.operators import ordering

    rows = [(None if k % 3 == 0 else k % 2, k % 50 if k % 5 else 7, 1) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, v int, one int")
    distinct = df.groupBy("g", "v").agg({"one": "sum"}).withColumnRenamed("sum(one)", "n")
    for build in (
        lambda size: ordering.running_sums(distinct, ["g"], "v", ["n"], size, with_next=True),
        lambda size: ordering.percentile_rank(df, ["g"], "v", "p", size),
        lambda size: ordering.running_max(distinct, ["g"], "v", "n", "top", size),
    ):
        whole, sliced = (sorted((tuple(sorted(r.asDict().items())) for r in build(size).collect()), key=str) for size in (1_000_000, 10))
        assert len(whole) == len(sliced) and str(whole) == str(sliced)


def test_slices_are_cut_until_each_is_small(spark):
    rows = [(0, k) for k in range(5000)] + [(1, k) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, v long")
    sliced = ordering.slice_values(df, ["g"], "v", 8)
    sizes = sliced.groupBy("g", "_slice").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "_slice").collect()
    assert max(r.n for r in sizes) <= 8 and len(sizes) > 600
    for a, b in zip(sizes, sizes[1:]):
        assert a.g != b.g or a.high < b.low


@pytest.mark.parametrize("ordered", [100_000, 1])
def test_selection_equals_a_full_ranking(spark, ordered):
    from gridrisk.operators import ranking

    pdf = pd.DataFrame({"s": np.where(RNG.random(3000) < 0.5, 0.25, RNG.random(3000) ** 9), "y": (RNG.random(3000) < 0.2).astype(int), "t": RNG.permutation(3000)})
    pdf.loc[:3, "s"] = [1e-300, 3e-300, 0.0, -5.0]
    fractions = (0.0, 0.001, 0.1, 0.33, 0.5, 0.9, 1.0)
    out = ranking.precision_at(spark.createDataFrame(pdf), "y", "s", "t", fractions, ordered).toPandas().set_index("fraction")
    ranked = pdf.sort_values(["s", "t"], ascending=[False, True]).reset_index(drop=True)
    for q in fractions:
        k = max(1, round(q * 3000))
        assert out.loc[q, "k"] == k and out.loc[q, "caught"] == ranked["y"][:k].sum()
        assert out.loc[q, "threshold"] == ranked["s"][k - 1] and out.loc[q, "recall"] == pytest.approx(ranked["y"][:k].sum() / ranked["y"].sum())
    assert ranking.precision_at(spark.createDataFrame(pdf).limit(0), "y", "s", "t", fractions).count() == 0
