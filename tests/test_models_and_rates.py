"""Class bootstraps, isotonic fits in slices, window shifts, stars and shipped models, against plain Python."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridrisk.functions import repair
from gridrisk.operators import bootstrap, calibration, components, evaluation, models
from gridrisk.plans import shipped

RNG = np.random.default_rng(21)


def plain_isotonic(points):
    blocks = []
    for x, n, h in sorted(points):
        blocks.append([x, x, n, h])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [tuple(b) for b in blocks]


@pytest.fixture(scope="module")
def labelled(spark):
    score = np.round(RNG.beta(2, 5, 3000), 3)
    label = (RNG.random(3000) < score * 0.7).astype(int)
    pdf = pd.DataFrame({"score": score, "label": label, "day": RNG.integers(0, 60, 3000)})
    return pdf, spark.createDataFrame(pdf)


def test_isotonic_blocks_at_any_slicing(spark, labelled):
    pdf, df = labelled
    points = [(x, len(g), int(g["label"].sum())) for x, g in pdf.groupby("score")]
    want = plain_isotonic(points)
    for slices, fan in ((1, 32), (3, 32), (40, 3), (40, 32)):
        got = calibration.isotonic_blocks(df, "label", "score", slices, fan).orderBy("first_x").collect()
        assert [tuple(r) for r in got] == want
    # falling labels pool into one block, rising ones stay apart
    down = spark.createDataFrame([(k / 10, int(k < 5)) for k in range(10)], "score double, label int")
    assert [tuple(r) for r in calibration.isotonic_blocks(down, "label", "score", 4, 2).collect()] == [(0.0, 0.9, 10, 5)]
    assert calibration.isotonic_knots(df.limit(0), "label", "score").count() == 0


def test_poisson_quantiles():
    for mean in (1, 3, 40, 1000, 250_000):
        u = RNG.random(4000)
        drawn = bootstrap.poisson_quantile(u[None, :], np.array([mean]))[0]
        assert abs(drawn.mean() - mean) < 6 * math.sqrt(mean / 4000) and (np.diff(drawn[np.argsort(u)]) >= 0).all()
    one = bootstrap.poisson_quantile(np.array([[0.0, 0.36, 0.37, 0.735, 0.736, 0.99999]]), np.array([1]))[0]
    assert one.tolist() == [0, 0, 1, 1, 2, 8]


def test_resampled_scores_do_not_depend_on_the_slices(spark, labelled):
    pdf, df = labelled
    whole = bootstrap.score_resamples(df, "label", "score", 40, 5).toPandas().sort_values("replicate").reset_index(drop=True)
    cut = bootstrap.score_resamples(df.repartition(7), "label", "score", 40, 5, slice_rows=17).toPandas().sort_values("replicate").reset_index(drop=True)
    assert np.allclose(whole, cut)
    # each replicate is the score of its own weighted rows
    factor, addend = bootstrap.coefficients(40, 5)
    classes = df.groupBy("score", "label").agg(F.count("*").alias("n")).withColumn("h", bootstrap.class_hash(5, F.col("label"), F.col("score"))).toPandas()
    for k in (0, 17):
        u = (classes["h"].to_numpy() * factor[k] + addend[k]) % bootstrap.PRIME / bootstrap.PRIME
        drawn = bootstrap.poisson_quantile(u[:, None], classes["n"].to_numpy())[:, 0]
        rows = spark.createDataFrame(classes.assign(w=drawn)[["score", "label", "w"]])
        want = evaluation.scores(rows, "label", "score", (), F.col("w")).first()
        assert np.allclose(whole.loc[k, ["auprc", "auroc", "lift"]].astype(float), [want["auprc"], want["auroc"], want["lift"]])
    point = evaluation.scores(df, "label", "score").first()
    assert abs(whole["auroc"].mean() - point["auroc"]) < 0.02


def test_cluster_medians_against_repeated_rows(spark, labelled):
    pdf, df = labelled
    frame = df.withColumn("other", F.sqrt("score"))
    got = bootstrap.paired_median_gaps(frame, "day", "score", "other", 25, 9).toPandas().set_index("replicate")["gap"]
    cut = bootstrap.cluster_medians(frame, "day", "score", 25, 9, slice_rows=13).toPandas().set_index("replicate")["median"]
    factor, addend = bootstrap.coefficients(25, 9)
    days = df.select("day").distinct().withColumn("h", bootstrap.class_hash(9, F.col("day"))).toPandas().set_index("day")["h"]
    for k in range(25):
        u = (pdf["day"].map(days).to_numpy() * factor[k] + addend[k]) % bootstrap.PRIME / bootstrap.PRIME
        rows = np.repeat(pdf["score"].to_numpy(), bootstrap.poisson_quantile(u[:, None], np.ones(len(pdf)))[:, 0])
        assert cut[k] == pytest.approx(np.median(rows))
        assert got[k] == pytest.approx(np.median(np.sqrt(rows)) - np.median(rows))


def test_window_choice_takes_the_prior_only_inside_the_interval(spark):
    z = RNG.normal(-2.0, 1.0, 4000)
    logits = spark.createDataFrame([(w, float(v)) for w in (1, 2) for v in z], "window int, z double")
    mean = float((1 / (1 + np.exp(-z))).mean())
    wide = [(1, 40, 1000, mean, mean * 0.8, mean * 1.2), (2, 40, 1000, 0.4, 0.39, 0.41)]
    rates = spark.createDataFrame(wide, "window int, ignitions long, cell_days long, rate double, low double, high double")
    record = spark.createDataFrame([(mean,)], "rate double")
    out = {r["window"]: r for r in calibration.window_choice(logits, rates, record).collect()}
    assert out[1]["prior_fits"] and out[1]["shift"] == out[1]["prior_shift"] == pytest.approx(0)
    assert not out[2]["prior_fits"] and out[2]["shift"] == out[2]["matched_shift"]
    assert (1 / (1 + np.exp(-z - out[2]["shift"]))).mean() == pytest.approx(0.4, abs=1e-8)
    with pytest.raises(Exception, match="no shift within"):
        calibration.matching_shifts(logits.groupBy("window", "z").count().withColumnRenamed("count", "n"), spark.createDataFrame([(1, 1.0), (2, 0.5)], "window int, target double")).collect()


def test_stars_find_components_with_hubs(spark):
    source = random.Random(3)
    links = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5300)] + [(source.randrange(6000, 7000), source.randrange(6000, 7000)) for _ in range(900)]
    links += [(8000, 8000), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    source.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long")
    for hub in (components.HUB, 50):
        got = {r.node: r.root for r in components.components(frame, hub=hub).collect()}
        assert got == {x: find(x) for x in parent}
    assert components.components(frame.limit(0)).count() == 0


def test_a_hub_is_dealt_over_tasks(spark):
    links = spark.range(1, 4001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    dealt = components._with_least(links, 100, 4000)
    sizes = [r["count"] for r in dealt.withColumn("p", F.pmod(F.xxhash64("v"), F.lit(40))).groupBy("p").count().collect()]
    assert dealt.count() == 4000 and max(sizes) < 3 * 100


def test_a_shipped_model_scores_days_as_the_fresh_one(spark, tmp_path):
    rows = [(k, f"2000-01-{1 + k % 5:02d}", float(k % 37), None if k % 11 == 0 else float((k * 7) % 23), int((k % 37) > 20 and k % 3 > 0), k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "cell_id long, day string, a double, b double, label int, fold int").withColumn("date", F.to_date("day")).drop("day")
    spec = models.Spec(("a", "b"), params={"rounds": 3, "depth": 3})
    fresh = shipped.ship(df, spec, "fold", 2, log_offset=-2.0, window_offset=0.5)
    fresh.save(spark, str(tmp_path / "m"))
    fresh.save(spark, str(tmp_path / "m"))
    loaded = shipped.Shipped.load(spark, str(tmp_path / "m"))
    assert loaded.spec == spec and loaded.calibration == fresh.calibration
    one, two = (shipped.scored_days(df, m, "2000-01-02", 3).toPandas().sort_values("cell_id").reset_index(drop=True) for m in (fresh, loaded))
    pd.testing.assert_frame_equal(one, two)
    assert sorted(str(d) for d in one["date"].unique()) == ["2000-01-02", "2000-01-03", "2000-01-04"]
    # rank and probability follow from the raw score in SQL
    knots = pd.DataFrame({"x": fresh.calibration.x, "y": fresh.calibration.y})
    con = duckdb.connect()
    con.register("scored", one)
    con.register("knots", knots)
    checked = con.execute(
        "WITH k AS (SELECT *, lead(x) OVER (ORDER BY x) x2, lead(y) OVER (ORDER BY x) y2 FROM knots), e AS (SELECT min(x) lo, max(x) hi, arg_min(y, x) ylo, arg_max(y, x) yhi FROM knots), "
        "s AS (SELECT cell_id, raw, probability, rank, CASE WHEN raw <= lo THEN ylo WHEN raw >= hi THEN yhi ELSE (SELECT any_value(y + (y2 - y) / (x2 - x) * (raw - x)) FROM k WHERE raw >= x AND raw < x2) END AS p FROM scored, e) "
        "SELECT max(abs(probability - 1 / (1 + exp(-(ln(p / (1 - p)) - 1.5))))) FROM s"
    ).fetchone()[0]
    assert checked < 1e-9
    assert np.allclose(one.groupby("date")["raw"].rank(pct=True), one["rank"])
    with pytest.raises(ValueError, match="lacks columns"):
        shipped.scored_days(df.drop("b"), loaded, "2000-01-02", 3)
    path = str(tmp_path / "days")
    assert len(shipped.pending_days(spark, path, "2000-01-01", 4)) == 4
    shipped.write_days(shipped.scored_days(df, loaded, "2000-01-02", 2), path)
    assert shipped.pending_days(spark, path, "2000-01-01", 4) == ["2000-01-01", "2000-01-04"]
    record = shipped.day_records(df, shipped.scored_days(df, loaded, "2000-01-02", 2), loaded).collect()
    assert len(record) == 2 and all(r.cells == 120 and [m.feature for m in r.missing] == ["b"] for r in record)


def test_split_fields_with_whole_dates_and_times(spark):
    texts = [" 31/7/2026 ", "99/99/2020", "1/2/26", "7:05", "07:05:30", "7:5:", "7", " 12 ", "3.5", "x", None, "1/2/2020/3", "a:10", "１/2/2020"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    read = lambda name: [tuple(r) for r in df.select("k", *(c.alias(n) for c, n in zip(repair.normalize_component(F.col("t"), name), "vr", strict=True))).orderBy("k").select("v", "r").collect()]
    plain = [(7.0, False), (12.0, False), (3.5, False)]
    assert read("day") == [(31.0, True), (99.0, True), (None, False), (None, False), (None, False), (None, False), *plain, (None, False), (None, False), (None, False), (None, False), (None, False)]
    assert read("year")[:2] == [(2026.0, True), (2020.0, True)]
    assert read("hour")[3:6] == [(7.0, True), (7.0, True), (None, False)] and read("minute")[3:5] == [(5.0, True), (5.0, True)]


def test_malformed_and_unexpected_bands_fail(spark):
    from gridrisk.sources import payloads

    good = spark.createDataFrame([("ndvi_200307",)], "t string")
    name, month = payloads.checked_band_name(F.col("t"), ["ndvi"])
    assert str(good.select(name, month).first()[1]) == "2003-07-01"
    for bad in ("ndvi_200313", "ndvi200307", "evi_200307", None):
        with pytest.raises(Exception, match="not a band name"):
            spark.createDataFrame([(bad,)], "t string").select(name, month).collect()
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", None)], "cell long, band string, value double")
    assert {tuple(r) for r in payloads.wide_bands(long, "cell", "band", "value", ["a", "b"]).collect()} == {(1, 2.0, 3.0), (2, None, None)}
    with pytest.raises(Exception, match="unexpected band: b"):
        payloads.wide_bands(long, "cell", "band", "value", ["a"]).collect()


def test_short_tracks_are_named_and_refused(spark):
    from gridrisk.sources import records

    rows = spark.createDataFrame([(t, s, 1.0) for t, n in ((1, 4), (2, 3)) for s in range(n)], "t int, step int, rain double")
    key = [F.lit("x"), F.col("t")]
    assert [tuple(r) for r in records.ragged_tracks(rows, key, 4).collect()] == [("x-2", 3)]
    with pytest.raises(Exception, match="not 4 days long"):
        records.target_days(rows, key, "step", 4, 3, "rain", (2,), {}).collect()


def test_draws_keep_the_ratio_exactly(spark, labelled):
    pdf, df = labelled
    few = bootstrap.fixed_ratio_draws(df, "label", "score", ratio=10, draws=60, seed=3, slice_rows=50).toPandas()
    p, q = int(pdf["label"].sum()), int((1 - pdf["label"]).sum())
    kept = min(p, q // 10)
    assert (few["positives"] == kept).all() and (few["negatives"] == 10 * kept).all() and len(few) == 60
    # the mean agrees with draws made row by row
    rng, own = np.random.default_rng(1), []
    for _ in range(60):
        rows = pd.concat([pdf[pdf["label"] == y].sample(n, random_state=int(rng.integers(1 << 30))) for y, n in ((1, kept), (0, 10 * kept))])
        classes = rows.groupby("score")["label"].agg(["sum", "count"]).sort_index(ascending=False).cumsum()
        hits = classes["sum"].diff().fillna(classes["sum"])
        own.append((hits * classes["sum"] / classes["count"]).sum() / kept)
    assert abs(few["auprc"].mean() - np.mean(own)) < 4 * (few["auprc"].std() + np.std(own)) / math.sqrt(60)
    assert few["auprc"].std() < 3 * np.std(own) < 9 * few["auprc"].std()
    all_of_it = bootstrap.fixed_ratio_draws(df.where("label = 1").unionByName(df.where("label = 0")), "label", "score", ratio=max(1, q // p), draws=3, slice_rows=50)
    assert all_of_it.count() == 3
    assert bootstrap.fixed_ratio_draws(df.where("label = 1"), "label", "score").count() == 0


def test_rounds_settle_and_trials_are_ranked(spark):
    from gridrisk.operators import tuning

    assert tuning.settled_rounds([5, 4, 3, 3.5, 3.2, 2, 1], 2) == 3 and tuning.settled_rounds([5, 4, 3, 3.5, 3.2, 2, 1], 3) == 7 and tuning.settled_rounds([1.0], 5) == 1
    space = {"depth": tuning.Range(2, 5, whole=True), "step": tuning.Range(0.01, 0.5, log=True)}
    drawn = tuning.draw_trials(space, 50, 3)
    assert {d["depth"] for d in drawn} == {2, 3, 4, 5} and all(0.01 <= d["step"] <= 0.5 for d in drawn) and drawn[:10] == tuning.draw_trials(space, 10, 3)
    assert tuning.on_the_boundary({"depth": 2, "step": 0.3}, space) == ["depth"] and tuning.on_the_boundary({"depth": 3, "step": 0.495}, space) == ["step"]
    rows = [(float(k % 41), float((k * 7) % 13), int((k % 41) > 25 and k % 3 > 0), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label int, fold int")
    spec = models.Spec(("a", "b"), params={"depth": 2})
    table = tuning.trial_table(df, spec, [{"step": 0.1}, {"step": 0.3}], "fold", 2, rounds=4, patience=2)
    pdf = table.toPandas().sort_values("trial")
    con = duckdb.connect()
    con.register("trials", pdf)
    for objective in tuning.OBJECTIVES:
        best = tuning.best_trial(table, objective)
        assert best["trial"] == con.execute(f"SELECT trial FROM trials ORDER BY {objective} DESC, trial LIMIT 1").fetchone()[0]
    model = tuning.final_fit(df, spec, best, {"step": tuning.Range(0.1, 0.3)})
    assert model.stages[-1].getNumTrees == best["rounds"] and 1 <= best["rounds"] <= 4
    # a run cut short is the beginning of the longer one
    losses = [tuning.staged_losses(models.fit(df, models.Spec(("a", "b"), params={"depth": 2, "rounds": n})), df, spec) for n in (2, 4)]
    assert np.allclose(losses[0], losses[1][:2])
    with pytest.raises(ValueError, match="not an objective"):
        tuning.best_trial(table, "auprc")
