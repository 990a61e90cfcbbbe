"""Steps that were mended for larger tables, against plain Python or the plan they had."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridrisk.plans import verification

DAY = dt.date(2000, 1, 1)


def test_temporal_percentile_lists_blocks_and_not_days(spark):
    rng = random.Random(3)
    days = {(c, DAY + dt.timedelta(d)): float(rng.randrange(5)) for c in range(4) for d in range(90) if rng.random() < 0.7}
    fires = [(k, rng.randrange(5), DAY + dt.timedelta(rng.randrange(90))) for k in range(60)]
    scored = spark.createDataFrame([(c, d, v) for (c, d), v in days.items()], "cell_id int, date date, raw double")
    events = spark.createDataFrame(fires, "fire_id int, cell_id int, event_date date")
    for reach in (0, 1, 15, 40):
        out = verification.temporal_percentile(events, scored, reach)
        want = {}
        for k, c, d in fires:
            around = [v for (c2, d2), v in days.items() if c2 == c and abs((d2 - d).days) <= reach]
            if (c, d) in days:
                own = days[c, d]
                want[k] = (len(around), (sum(v < own for v in around) + (sum(v == own for v in around) + 1) / 2) / len(around))
        assert {r.fire_id: (r.window_days, r.temporal_percentile) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "interval" not in plan.lower()  # no row a day
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in physical


def test_remote_boxes_keep_few_pieces(spark, monkeypatch):
    """Remote points of a dense region met every piece of its rim, box by box of points few stay."""
    import numpy as np

    from gridrisk.operators import spatial

    rng = np.random.default_rng(5)
    a = rng.uniform(0, 20000, (4000, 2))
    b = a + rng.uniform(-1500, 1500, a.shape)
    q = np.concatenate([rng.uniform([0, -9e5], [20000, 0], (1500, 2)), rng.uniform(-3000, 23000, (500, 2))])
    lines = spark.createDataFrame([(*map(float, u), *map(float, v)) for u, v in zip(a, b, strict=True)], "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(q)], "p int, x double, y double")
    met = []
    whole = spatial._pieces_of_boxes
    monkeypatch.setattr(spatial, "_pieces_of_boxes", lambda *args: met.append(whole(*args)) or met[-1])
    got = {r.p: r.distance for r in spatial.nearest_distance(points, lines, 4000.0, ["p"]).collect()}
    d = b - a
    for k, p in enumerate(q):
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert abs(got[k] - np.linalg.norm(p - (a + t[:, None] * d), axis=1).min()) < 1e-6
    remote = met[0].where("_gy < -20").groupBy("_gx", "_gy").count().agg(F.max("count")).first()[0]
    assert remote <= 64


def test_boosted_trees_learn_from_classes_what_they_learn_from_rows(spark, monkeypatch):
    """The learner used to be given, and cached, every row."""
    from gridrisk.operators import models as ml

    rng = random.Random(2)
    rows = [(rng.choice([None, 1.0, 2.0, 3.0]), float(rng.randrange(40)), rng.randrange(3) == 0, k) for k in range(3000)]
    rows = [(a, b, int(c or (b > 30 and a == 2.0)), k) for a, b, c, k in rows]
    df = spark.createDataFrame(rows, "a double, b double, label int, k int").repartition(3)
    spec = ml.Spec(("a", "b"), params={"rounds": 4, "depth": 3})
    given = []
    plain = ml.collapsed
    monkeypatch.setattr(ml, "collapsed", lambda binned, *rest: given.append((binned, plain(binned, *rest))) or given[-1][1])
    few = ml.fit(df, spec)
    assert given[0][1].count() <= 4 * 32 * 2 < given[0][0].count() == 3000
    monkeypatch.setattr(ml, "collapsed", lambda binned, spec, *more: binned.select(*ml._binned(spec), "_label", *more, "_weight"))
    every = ml.fit(df, spec)
    a, b = ({r.k: r.raw for r in ml.predict(m, df, spec).collect()} for m in (few, every))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_excluded_days_are_bits_before_they_are_shuffled(spark):
    from gridrisk.operators import calibration, events, sampling

    rng = random.Random(8)
    days = [(c, DAY + dt.timedelta(rng.randrange(-70, 200))) for c in range(6) for _ in range(150)]
    pairs = spark.createDataFrame(days, "cell_id int, date date")
    positions = spark.createDataFrame([(c, c) for c in range(5)], "cell_id int, position bigint")
    first, n = "2000-01-01", 100
    want = {c * n + (d - DAY).days for c, d in days if c < 5 and 0 <= (d - DAY).days < n}
    flat = [r.flat for r in sampling.flat_exclusions(positions, pairs, first, n).collect()]
    assert len(flat) == len(want) and set(flat) == want
    assert sampling.pool_size(positions, pairs, first, n) == 5 * n - len(want)
    out = calibration.sampling_rate(positions, pairs, first, "2000-04-09", positions).first()
    assert out.excluded_cell_days == len(want)
    drawn = sampling.sample_negatives(positions, pairs, 5 * n - len(want), first, n, 3).collect()
    assert {r.cell_id * n + (r.date - DAY).days for r in drawn} == set(range(5 * n)) - want
    masks = events.day_masks(pairs, ["cell_id"], F.lit(first).cast("date"))
    assert masks.count() <= 6 * 10
    back = [(r.cell_id, r.offset) for r in events.days_of(masks).collect()]
    assert len(back) == len(set(back)) and set(back) == {(c, (d - DAY).days) for c, d in days}


def test_near_other_events_meet_blocks_of_days(spark):
    from gridrisk.operators import events

    rng = random.Random(4)
    fires = [(k, rng.randrange(8), DAY + dt.timedelta(rng.randrange(-40, 60))) for k in range(50)]
    ev = spark.createDataFrame(fires, "fire_id int, cell_id int, start_date date").withColumn("end_date", F.date_add("start_date", 2))
    near = spark.createDataFrame([(k, c + i) for k, c, _ in fires for i in (-1, 0, 1)], "fire_id int, cell_id int")
    pairs = events.exclusion_pairs(ev, near, near)
    positives = ev.select("cell_id", F.col("start_date").alias("date")).distinct()
    out = events.near_other_events(positives, pairs, ev)
    want = {(c, d): any(abs(c2 - c) <= 1 and -2 <= (d - d2).days <= 4 and (c2, d2) != (c, d) for _, c2, d2 in fires) for _, c, d in fires}
    assert {(r.cell_id, r.date): r.is_near_fire for r in out.collect()} == want and len(set(want.values())) == 2
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_an_event_go_round_the_join_with_hours(spark):
    from gridrisk.operators import events

    rng = random.Random(6)
    hours = {k: rng.randrange(24) for k in range(0, 80, 2)}
    rows = [(k, rng.randrange(4), DAY + dt.timedelta(rng.randrange(6)), rng.choice([True, True, False, None]), rng.choice([k, k, None])) for k in range(120)]
    samples = spark.createDataFrame(rows, "sample_id int, cell_id int, date date, is_fire boolean, fire_id int")
    fires = spark.createDataFrame(list(hours.items()), "fire_id int, start_hour int")
    out = events.shift_near_midnight(samples, fires, "2000-01-01", "2000-01-05")
    want = {}
    for k, c, d, hit, f in rows:
        hour = hours.get(f, 12) if hit else 12
        d += dt.timedelta((hour >= 22) - (hour < 2))
        rank = (hit is not None, bool(hit), -k)
        if DAY <= d <= DAY + dt.timedelta(4) and rank > want.get((c, d), ((False, False, -999), None))[0]:
            want[c, d] = (rank, (k, hit, f))
    assert {(r.cell_id, r.date): (r.sample_id, r.is_fire, r.fire_id) for r in out.collect()} == {k: v for k, (_, v) in want.items()}
    assert out.columns == samples.columns
    # without an event they had one key, and met in one task
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_class_sizes_do_not_move_the_rows(spark):
    from gridrisk.operators import sampling

    rng = random.Random(7)
    rows = [(k, rng.randrange(3), rng.choice("aab")) for k in range(300)]
    df = spark.createDataFrame(rows, "row_id int, year int, label string")
    size = {b: min(sum(r[1:] == (y, b) for r in rows) for y in range(3)) for b in "ab"}
    out = sampling.size_matched(df, "year", "label", "row_id", 11).groupBy("year", "label").count().collect()
    assert {(r.year, r.label): r["count"] for r in out} == {(y, b): size[b] for y in range(3) for b in "ab"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in sampling.with_sizes(df, "year", "label")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cells_of_a_row_merge_as_bits(spark):
    """Wider than a block of columns, with cells that several edges and the area itself name."""
    from gridrisk.functions import geometry as geo
    from gridrisk.operators import spatial
    from gridrisk.operators.grid import GridSpec

    spec = GridSpec(0.0, 1000.0, 150, 10, 100)
    rng = random.Random(9)
    boxes = [(k, rng.uniform(-300, 12000), rng.uniform(-200, 900), rng.uniform(1, 9000), rng.uniform(1, 400)) for k in range(40)]
    rows = [(k, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]) for k, x, y, w, h in boxes]
    shapes = spark.createDataFrame(rows, "geom_id int, ring array<struct<x: double, y: double>>").select("geom_id", geo.edges(F.col("ring")).alias("sides"))
    out = spatial.buffered_cells(shapes, spec, 130.0)
    want = set()
    for k, x, y, w, h in boxes:
        for cell in range(1500):
            x0, y0 = cell % 150 * 100.0, 900.0 - cell // 150 * 100.0
            dx, dy = max(x0 - x - w, 0, x - x0 - 100), max(y0 - y - h, 0, y - y0 - 100)
            if dx * dx + dy * dy < 130.0**2:
                want.add((k, cell))
    got = [(r.geom_id, r.cell_id) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString()
