"""Steps that were mended for larger tables in round 4, against plain Python or the plan they had."""

import numpy as np
from pyspark.sql import functions as F

from gridrisk.operators import spatial


def hanging_lines(n: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Lines of different lengths that all go south from where they begin."""
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 20000, (n, 2))
    return a, a + np.stack([rng.uniform(-1500, 1500, n), -rng.uniform(0, 1600, n)], 1)


def test_pairs_of_boxes_are_not_broadcast_and_remote_boxes_open_few(spark, monkeypatch):
    """Staged pairs are small as compressed files, so the planner used to send them by the driver.

    Remote boxes kept all boxes of pieces whose far ends might be nearest, since one end alone was known of each.
    """
    a, b = hanging_lines(4000)
    rng = np.random.default_rng(6)
    q = np.concatenate([rng.uniform([0, -9e5], [20000, -1e5], (1500, 2)), rng.uniform(-3000, 23000, (300, 2))])
    lines = spark.createDataFrame([(*map(float, u), *map(float, v)) for u, v in zip(a, b, strict=True)], "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(q)], "p int, x double, y double")
    plans, opened, cut = [], [], spatial.cut_lineage

    def seen(df, name="stage"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        out = cut(df, name)
        if name == "open-boxes":
            remote = out.where("_gy * 4000.0 < -90000").groupBy("_gx", "_gy").count().agg(F.max("count")).first()[0]
            opened.append(remote or 0)
        return out

    monkeypatch.setattr(spatial, "cut_lineage", seen)
    got = {r.p: r.distance for r in spatial.nearest_distance(points, lines, 4000.0, ["p"]).collect()}
    d = b - a
    for k, p in enumerate(q):
        t = np.clip(((p - a) * d).sum(1) / ((d * d).sum(1)), 0, 1)
        assert abs(got[k] - np.linalg.norm(p - (a + t[:, None] * d), axis=1).min()) < 1e-6
    sent = [name for name, plan in plans if "BroadcastHashJoin" in plan]
    assert set(sent) <= {"places", "nearest"}  # the names of few crowded boxes alone
    assert sent.count("nearest") <= 1
    # one end of a box of pieces known: 42
    assert opened and max(opened) <= 16, opened


def labelled_years(spark):
    rng = np.random.default_rng(8)
    rows = [(int(c), f"{y}-{m:02d}-{d:02d}", int(y), float(q), float(p)) for y in range(1995, 2002) for m in (2, 8) for d in (3, 9, 12) for c in range(12) for q, p in [rng.normal(size=2)]]
    table = spark.createDataFrame(rows, "cell_id int, date string, year int, quantity double, price double")
    return table.select("*", (F.col("quantity") + F.col("price") > 0.8).cast("int").alias("label")).withColumn("date", F.to_date("date"))


def test_a_model_settles_as_a_run_of_all_rounds_does(spark):
    from gridrisk.operators import models as ml
    from gridrisk.operators import tuning as tn

    table = labelled_years(spark)
    learn, held = table.where("year < 1998"), table.where("year = 1998")
    spec = ml.Spec(("quantity", "price"), params={"depth": 2, "step": 0.9})
    whole = ml.fit(learn, ml.Spec(spec.numeric, params={**spec.params, "rounds": 16}))
    want = tn.settled_rounds(tn.staged_losses(whole, held, spec), 2)
    model, settled = tn.settled_model(learn, held, spec, 16, 2)
    assert settled == want == model.stages[-1].getNumTrees


def test_retraining_variants_run_whole(spark, monkeypatch):
    """The query used to fit three rounds once a variant: no folds, no settling, no resamples."""
    from gridrisk.catalog import models as cm
    from gridrisk.operators import tuning as tn
    from gridrisk.operators import variants as va

    class Given:
        def __getattr__(self, name):
            return labelled_years(spark)

    seen = []
    settle, resample = va.settled_model, va.cluster_medians
    monkeypatch.setattr(cm, "rows", lambda t, n=2: labelled_years(spark).withColumn("fold", F.lit(0)))
    monkeypatch.setattr(cm, "FEATURES", ("quantity", "price"))
    monkeypatch.setattr(cm, "RETRAINED", {"from_1996": va.Variant(first_year=1996), "reference": va.Variant(), "recency": va.Variant(half_life=2.0), "one": va.Variant(numeric=("price",))})

    def settled(learn, held, spec, rounds, patience):
        years = [{r.year for r in df.select("year").distinct().collect()} for df in (learn, held)]
        seen.append((spec.numeric, spec.weight, rounds, patience, *years))
        return settle(learn, held, spec, 2, 1)

    drawn = []
    monkeypatch.setattr(va, "settled_model", settled)
    monkeypatch.setattr(va, "cluster_medians", lambda df, day, value, n, seed: drawn.append(n) or resample(df, day, value, n, seed))
    out = {r.variant: r for r in cm.retraining_variants(Given()).collect()}
    assert list(out) == list(cm.RETRAINED)
    assert {(s[2], s[3]) for s in seen} == {(tn.ROUNDS, tn.PATIENCE)} == {(2000, 50)} and set(drawn) == {1000}
    plain = [s for s in seen if s[1] is None and s[0] == ("quantity", "price")]
    # five blocks of one year each, four without 1995; each block is scored by the others
    assert sorted(len(s[4]) for s in plain) == [3] * 4 + [4] * 5 and all(len(s[5]) == 1 and not s[4] & s[5] for s in seen)
    assert sum(s[1] == "_recency" for s in seen) == sum(s[0] == ("price",) for s in seen) == 5
    hits = labelled_years(spark).where("year >= 2000 and label = 1").count()
    assert {r.events for r in out.values()} == {hits}
    base = out["reference"]
    assert base.median_gap == base.gap_lo == base.gap_hi == base.summer_median_gap == 0 and base.passes
    for r in out.values():
        assert r.rounds == base.rounds and r.auprc_lo <= r.auprc_hi and r.gap_lo <= r.gap_hi
        assert abs(r.median_gap - (r.median_percentile - base.median_percentile)) < 1e-12
        assert r.passes == (r.auprc - base.auprc >= -0.02 and r.median_percentile >= base.median_percentile)
