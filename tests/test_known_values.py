"""Hand-computed cases of the single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridrisk.functions import calendar, lookup, physics, repair
from gridrisk.functions import geometry as geo
from gridrisk.operators import climate, evaluation, events, fire_weather, joins, ordering
from gridrisk.operators import ranking, spatial
from gridrisk.operators import windows as w
from gridrisk.operators.grid import GridSpec, Lattice, bilinear_weights, snap_extent

DAY0 = dt.date(2003, 1, 1)


def days(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def ring(*corners):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners))
    return geo.edges(points)


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def test_trailing_sum_needs_the_whole_window(spark):
    df = spark.createDataFrame([(1, d, float(i)) for i, d in enumerate(days(10))], "c int, d date, v double")
    out = df.select("d", w.trailing_sum(["c"], "d", "v", 7).alias("s")).orderBy("d").collect()
    assert [r.s for r in out[:6]] == [None] * 6
    assert [r.s for r in out[6:]] == [21.0, 28.0, 35.0, 42.0]


def test_a_gap_empties_the_windows_over_it_only(spark):
    kept = [(1, d, 1.0) for i, d in enumerate(days(10)) if i != 4]
    df = spark.createDataFrame(kept, "c int, d date, v double")
    out = {r.d: r.s for r in df.select("d", w.trailing_sum(["c"], "d", "v", 3).alias("s")).collect()}
    assert out[days(10)[3]] == 3.0 and out[days(10)[5]] is None and out[days(10)[7]] == 3.0


def test_preceding_maximum_leaves_the_day_out(spark):
    values = [100.0, 900.0, 200.0, 50.0, 0.0, 3000.0]
    df = spark.createDataFrame([(1, d, v) for d, v in zip(days(6), values)], "c int, d date, v double")
    out = df.select("d", w.preceding_max(["c"], "d", "v", 3).alias("m")).orderBy("d").collect()
    assert [r.m for r in out] == [None, None, None, 900.0, 900.0, 200.0]


@pytest.mark.parametrize(
    "rain, expected",
    [
        ({2: 5.0, 5: 0.4}, [None, None, 0, 1, 2, 3, 4, 4, 4, 4]),
        ({0: 1.0}, [0, 1, 2, 3, 4, 4, 4, 4, 4, 4]),
        ({}, [None, None, None, 4, 4, 4, 4, 4, 4, 4]),
    ],
)
def test_dry_streak(spark, rain, expected):
    rows = [(1, d, rain.get(i, 0.0)) for i, d in enumerate(days(10))]
    df = spark.createDataFrame(rows, "c int, d date, v double")
    out = df.select("d", w.days_since(["c"], "d", "v", 1.0, 4).alias("n")).orderBy("d").collect()
    assert [r.n for r in out] == expected


def test_capped_fill_keeps_the_age(spark):
    months = [dt.date(2003, m, 1) for m in range(1, 8)]
    rows = [(1, m, 0.5 if m.month == 1 else 0.8 if m.month == 7 else None, 1.0 if m.month in (1, 7) else 0.0) for m in months]
    df = spark.createDataFrame(rows, "c int, m date, v double, f double")
    out = w.carry_forward(df, ["c"], "m", ["v"], F.col("f") >= 0.2, 120).orderBy("m").collect()
    assert [r.v for r in out] == [0.5] * 5 + [None, 0.8]
    assert [r.age_days for r in out] == [0, 31, 59, 90, 120, None, 0]


def test_impossible_dates_are_null_and_bad_times_midnight(spark):
    df = spark.createDataFrame(
        [("31", "2", "1999", "5", "5"), ("abc", "2", "1999", "5", "5"), ("1", "2", "1999", "99", "5"), ("03/04/2001", "4", "2001", "21:30:05", "21:30:05")],
        "d string, m string, y string, h string, mi string",
    )
    values, fixed = repair.normalize_fields([F.col(c) for c in ("d", "m", "y", "h", "mi")])
    out = df.select(repair.build_datetime(*values.values()).alias("t"), fixed.alias("f")).collect()
    assert [r.t for r in out] == [None, None, dt.datetime(1999, 2, 1, 0, 5), dt.datetime(2001, 4, 3, 21, 30)]
    assert [r.f for r in out] == [False, False, False, True]


def test_calendar(spark):
    rows = [(dt.date(2024, 8, 15),), (dt.date(2024, 8, 17),), (dt.date(2023, 12, 31),), (dt.date(2024, 4, 1),)]
    out = {r.date: r for r in calendar.calendar_features(spark.createDataFrame(rows, "date date")).collect()}
    first = out[dt.date(2024, 8, 15)]
    assert (first.month, first.season, first.day_of_week, first.is_weekend, first.is_holiday) == (8, "summer", 3, False, True)
    assert (out[dt.date(2024, 8, 17)].is_weekend, out[dt.date(2024, 8, 17)].is_holiday) == (True, False)
    assert (out[dt.date(2023, 12, 31)].season, out[dt.date(2023, 12, 31)].day_of_week) == ("winter", 6)
    assert out[dt.date(2024, 4, 1)].is_holiday


def test_humidity_and_wind(spark):
    one = spark.range(1)
    pairs = [(20.0, 20.0, 100.0), (20.0, 10.0, 52.54), (5.0, 9.0, 100.0)]
    for temp, dew, expected in pairs:
        got = one.select(physics.relative_humidity(F.lit(temp), F.lit(dew))).first()[0]
        assert got == pytest.approx(expected, abs=0.01)
    for u, v, expected in [(0, -1, 0), (-1, 0, 90), (0, 1, 180), (1, 0, 270), (3, -4, 323.13)]:
        got = one.select(physics.wind_from(F.lit(float(u)), F.lit(float(v)))).first()[0]
        assert got == pytest.approx(expected, abs=0.01)


def test_interpolation_weights_and_missing_neighbours(spark):
    samples = spark.createDataFrame([(1, 0, DAY0)], "sample_id int, cell_id int, date date")
    weights = spark.createDataFrame([(0, i, v) for i, v in enumerate((0.4, 0.3, 0.2, 0.1))], "cell_id int, era5_id int, weight double")

    def backbone(last):
        return spark.createDataFrame([(i, DAY0, v) for i, v in enumerate((10.0, 20.0, 30.0, last))], "era5_id int, date date, t double")

    assert joins.interpolate(samples, weights, backbone(40.0), ["t"], ["sample_id"]).first().t == 20.0
    assert joins.interpolate(samples, weights, backbone(None), ["t"], ["sample_id"]).first().t is None
    with pytest.raises(Exception, match="do not sum to 1"):
        joins.interpolate(samples, weights.where("era5_id < 3"), backbone(40.0), ["t"], ["sample_id"]).collect()


def test_heaviest_neighbour_ties_go_low(spark):
    rows = [(0, 5, 0.5), (0, 3, 0.5), (1, 7, 0.6), (1, 2, 0.4)]
    df = spark.createDataFrame(rows, "cell_id int, era5_id int, weight double")
    assert {r.cell_id: r.era5_id for r in joins.heaviest_neighbour(df).collect()} == {0: 3, 1: 7}


def test_a_repeated_right_key_fails(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="repeats a key"):
        joins.join_to_one(left, right, ["k"]).collect()


def test_edition_ties_go_to_the_earlier(spark):
    df = spark.createDataFrame([(y,) for y in (1995, 2003, 2009, 2015, 2024)], "y int")
    out = df.select(joins.nearest_edition(F.col("y"), [1990, 2000, 2006, 2012, 2018]).alias("e")).collect()
    assert [r.e for r in out] == [1990, 2000, 2006, 2012, 2018]


def test_composite_of_the_own_month_is_never_used(spark):
    left = spark.createDataFrame([(i, 0, d) for i, d in enumerate((dt.date(2003, 3, 17), dt.date(2003, 3, 1), dt.date(2003, 3, 31), dt.date(2003, 1, 1)))], "i int, c int, d date")
    composites = spark.createDataFrame([(0, dt.date(2003, m, 1), float(m)) for m in (1, 2, 3)], "c int, m date, v double")
    out = joins.preceding_join(left, composites, ["c"], "d", "m").orderBy("i").collect()
    assert [r.composite_month for r in out] == [dt.date(2003, 2, 1)] * 3 + [None]


def test_snapped_extent(spark):
    df = spark.createDataFrame([(612484.81, 5059545.95), (728617.25, 5157140.40)], "x double, y double")
    r = snap_extent(df, "x", "y", 500.0).first()
    assert (r.xmin, r.ymax, r.n_cols, r.n_rows) == (612000.0, 5157500.0, 234, 196)


SPEC = GridSpec(0, 5000, 5, 5, 1000)


def test_half_open_cells(spark):
    points = [(0, 5000, 0), (1000, 5000, 1), (0, 4000, 5), (5000, 4500, -1), (500, 0, -1), (-1, 4500, -1)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, e double")
    out = df.select(SPEC.cell_of(F.col("x"), F.col("y")).alias("c"), "e").collect()
    assert all(r.c == r.e for r in out)


def test_polygon_cells_ignore_touching(spark):
    one = spark.range(1).withColumnRenamed("id", "geom_id")
    for corners, expected in [((500, 3500, 2500, 4500), {0, 1, 2, 5, 6, 7}), ((1000, 4000, 2000, 5000), {1})]:
        shape = one.withColumn("sides", box(*corners))
        assert {r.cell_id for r in spatial.polygon_cells(shape, SPEC).collect()} == expected


def test_a_buffer_of_one_cell_reaches_the_ring(spark):
    shape = spark.range(1).withColumnRenamed("id", "geom_id").withColumn("sides", box(2000, 2000, 3000, 3000))
    assert {r.cell_id for r in spatial.buffered_cells(shape, SPEC, 1000.0).collect()} == {6, 7, 8, 11, 12, 13, 16, 17, 18}


def test_bilinear_weights(spark):
    lattice = Lattice(10.4, 46.6, 0.1, 3, 3)
    df = spark.createDataFrame([(0, 10.45, 46.55), (1, 10.0, 47.0)], "c int, lon double, lat double")
    out = bilinear_weights(df, lattice, "c", "lon", "lat").collect()
    assert {r.era5_id: round(r.weight, 6) for r in out if r.c == 0} == {0: 0.25, 1: 0.25, 3: 0.25, 4: 0.25}
    assert {r.era5_id: r.weight for r in out if r.c == 1} == {0: 1.0}


def test_line_distance_stats(spark):
    grid = GridSpec(0, 10, 2, 1, 10)
    cells = spark.createDataFrame([(0,), (1,)], "cell_id bigint")
    line = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0)], "x1 double, y1 double, x2 double, y2 double")
    out = {r.cell_id: (r.distance_mean, r.distance_std) for r in spatial.line_distance_stats(cells, grid, line, 2, 4.0).collect()}
    assert out[0] == pytest.approx((5.0, 2.5)) and out[1] == pytest.approx((15.0, 2.5))
    empty = spatial.line_distance_stats(cells, grid, line.where("false"), 2, 4.0).collect()
    assert all(r.distance_mean is None for r in empty)


def test_exclusion_levels(spark):
    ev = spark.createDataFrame([(1, dt.date(2003, 6, 10), dt.date(2003, 6, 12))], "fire_id int, start_date date, end_date date")
    burned = spark.createDataFrame([(1, 12)], "fire_id int, cell_id int")
    ring_cells = spark.createDataFrame([(1, c) for c in (6, 7, 8, 11, 12, 13, 16, 17, 18)], "fire_id int, cell_id int")
    out = events.unique_exclusions(events.exclusion_pairs(ev, burned, ring_cells)).collect()
    assert len(out) == 63 and sum(r.level == 2 for r in out) == 3


def test_scores_and_top_fractions(spark):
    labels = [1, 0, 1, 0, 1, 0, 0, 0, 0, 0]
    rows = [(i, y, 0.9 - i / 10) for i, y in enumerate(labels)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    top = {r.fraction: r for r in ranking.precision_at(df, "label", "score", "id", [0.2, 0.5]).collect()}
    assert (top[0.2].k, top[0.2].caught, top[0.2].precision) == (2, 1, 0.5)
    assert (top[0.5].k, top[0.5].caught, top[0.5].recall) == (5, 3, 1.0)
    out = evaluation.scores(df, "label", "score").first()
    assert out.auprc == pytest.approx((1 + 2 / 3 + 3 / 5) / 3) and out.auroc == pytest.approx(18 / 21)


def test_reliability_of_two_bins(spark):
    labels, values = [0, 0, 0, 1, 0, 1, 1, 1], [0.05, 0.1, 0.15, 0.2, 0.6, 0.7, 0.8, 0.9]
    df = spark.createDataFrame(list(zip(labels, values)), "label int, score double")
    bins = evaluation.reliability(df, "label", "score", 2).orderBy("bin").collect()
    assert [r.observed for r in bins] == [0.25, 0.75]
    same = spark.createDataFrame([(0, 0.02)] * 9 + [(1, 0.8)], "label int, score double")
    assert sum(r["count"] for r in evaluation.reliability(same, "label", "score", 10).collect()) == 10


def test_classes_and_ladder(spark):
    one = spark.range(1)
    breaks = [0.1, 0.2]
    assert [one.select(lookup.classify(F.lit(v), breaks)).first()[0] for v in (0.05, 0.1, 0.3)] == [0, 1, 2]
    assert one.select(lookup.classify(F.lit(None).cast("double"), breaks)).first()[0] == -1


def test_quantile_map_holds_the_ends(spark):
    knots = spark.createDataFrame([(0, 1, "v", [(float(2 * i), float(i)) for i in range(11)])], "n int, month int, column string, knots array<struct<x:double,y:double>>")
    rows = [(0, dt.date(2003, 1, 1 + i), v) for i, v in enumerate((2.0, 8.0, -5.0, 500.0))] + [(0, dt.date(2003, 2, 1), 8.0)]
    df = spark.createDataFrame(rows, "n int, d date, v double")
    out = [r.v for r in climate.map_quantiles(df, knots, "n", "d", ["v"]).orderBy("d").collect()]
    assert out == [1.0, 4.0, 0.0, 10.0, 8.0]


def test_published_fire_weather_days(spark):
    inputs = [(17, 42, 25, 0), (20, 21, 25, 2.4), (8.5, 40, 17, 0), (6.5, 25, 6, 0), (13, 34, 24, 0)]
    rows = [(1, dt.date(2003, 4, 13 + i), *map(float, r)) for i, r in enumerate(inputs)]
    df = spark.createDataFrame(rows, "c int, d date, t double, h double, w double, r double")
    out = fire_weather.fire_weather(df, "c", "d", "t", "h", "w", "r").orderBy("d").collect()
    expected = [
        (87.7, 8.5, 19.0, 10.9, 8.5, 10.1),
        (86.2, 10.4, 23.6, 8.8, 10.4, 9.3),
        (87.0, 11.8, 26.1, 6.5, 11.7, 7.6),
        (88.8, 13.2, 28.2, 4.9, 13.1, 6.2),
        (89.1, 15.4, 31.5, 12.6, 15.3, 14.8),
    ]
    for row, want in zip(out, expected):
        assert (row.ffmc, row.dmc, row.dc, row.isi, row.bui, row.fwi) == pytest.approx(want, abs=0.06)


def test_variance_share_extremes(spark):
    from gridrisk.operators.reports import variance_share

    frozen = spark.createDataFrame([(c, float(c)) for c in (0, 1) for _ in range(3)], "c int, v double")
    swapped = spark.createDataFrame([(0, 0.0), (1, 1.0), (0, 1.0), (1, 0.0)], "c int, v double")
    assert variance_share(frozen, "c", F.col("v")).first().share == pytest.approx(1.0)
    assert variance_share(swapped, "c", F.col("v")).first().share == pytest.approx(0.0)


def test_projection_goes_both_ways(spark):
    lon, lat = geo.from_utm(F.lit(664000.0), F.lit(5104000.0))
    x, y = geo.to_utm(lon, lat)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == pytest.approx((664000.0, 5104000.0), abs=1e-3)
    assert 11.0 < r.lon < 11.3 and 46.0 < r.lat < 46.2
    # on the central meridian the easting is the false one
    x0, _ = geo.to_utm(F.lit(9.0), F.lit(46.0))
    assert spark.range(1).select(x0).first()[0] == pytest.approx(500000.0, abs=1e-6)


def test_percentile_rank_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "v double")
    out = [r.p for r in ordering.percentile_rank(df, (), "v", "p").orderBy("v").collect()]
    assert out == [None, 0.25, 0.625, 0.625, 1.0]
