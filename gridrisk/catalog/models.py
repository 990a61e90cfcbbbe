"""Section I with the learners: what does not depend on the learner has a SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import Tables
from gridrisk.functions.calendar import period_label
from gridrisk.operators import evaluation as evl
from gridrisk.operators import models as ml
from gridrisk.operators import tuning as tn
from gridrisk.operators import variants as va
from gridrisk.operators.sampling import repeated_draws
from gridrisk.session import cut_lineage

FEATURES = ("quantity", "price", "discount", "tax", "month")
QUICK = {"rounds": 3, "depth": 3}


def rows(t: Tables, n_folds: int = 2):
    """Lineitem as a labelled design table with a few missing values and year folds.

    Written once, since every fit reads it again.
    """
    price = F.col("l_extendedprice")
    hit = F.col("l_returnflag") == "R"
    table = t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_suppkey").alias("cell_id"),
        F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_orderkey") % 17 > 0, F.col("l_quantity")).alias("quantity"),
        F.when(hit, price * 1.1).otherwise(price).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.month("l_shipdate").cast("double").alias("month"),
        hit.cast("int").alias("label"),
    )
    folds = evl.year_folds(table, "year", n_folds)
    # one row per year
    return cut_lineage(table.join(F.broadcast(folds), "year"), "design")


SPEC = ml.Spec(FEATURES, params=QUICK)



@query("i16_cross_validation")
def cross_validation(t: Tables):
    held_out = ml.cross_validate(rows(t, 3), SPEC, "fold", 3)
    return ml.fold_summary(held_out, "label", "fold").select(
        "fold", "auprc", "auroc", "brier", "positive_rate", "lift"
    )


BLOCK_M = 2000.0
BLOCKS_SQL = (
    "c AS (SELECT l_returnflag, floor((6e5 + (l_suppkey % 40) * 5e2 + 25e1) / 2e3) AS bx, floor((52e5 - (l_suppkey // 40) * 5e2 - 25e1) / 2e3) AS yb FROM lineitem), "
    "e AS (SELECT min(bx) AS x0, max(bx) AS x1, min(yb) AS y0 FROM c), b AS (SELECT l_returnflag, CAST((yb - y0) * (x1 - x0 + 1) + (bx - x0) AS BIGINT) AS block FROM c, e), "
    "f AS (SELECT block, ntile(3) OVER (ORDER BY CAST('0x' || substr(md5('42|' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT), block) - 1 AS fold FROM (SELECT DISTINCT block FROM b))"
)


def blocked(t: Tables):
    """The design rows with folds of whole square blocks of cells, neighbours being held out together."""
    cell = F.col("cell_id")
    x, y = F.lit(6e5) + cell % 40 * 500.0 + 250.0, F.lit(52e5) - F.floor(cell / 40) * 500.0 - 250.0
    placed = evl.block_id(rows(t).drop("fold").withColumns({"x": x, "y": y}), "x", "y", BLOCK_M)
    return cut_lineage(placed.join(evl.group_folds(placed, "block", 3, 42), "block"), "blocked")


@query("i16_spatial_cross_validation")
def spatial_cross_validation(t: Tables):
    held_out = ml.cross_validate(blocked(t), SPEC, "fold", 3)
    return ml.fold_summary(held_out, "label", "fold").select("fold", "auprc", "auroc")


@query(
    "i16_block_folds",
    f"WITH {BLOCKS_SQL} SELECT CAST(fold AS INT) AS fold, count(DISTINCT block) AS blocks, count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS positives FROM b JOIN f USING (block) GROUP BY fold",
)
def block_folds(t: Tables):
    return blocked(t).groupBy("fold").agg(F.count_distinct("block").alias("blocks"), F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"))


@query("i17_boosted_trees")
def boosted_trees(t: Tables):
    """Early stopping watches the last training year; the years after it are scored."""
    table = rows(t)
    spec = ml.Spec(FEATURES, params={**QUICK, "rounds": 8, "early_stop": 1})
    model = ml.fit(table.where("year < 2000"), spec, held=F.col("year") == 1999)
    scored = ml.predict(model, table.where("year >= 2000"), spec)
    return scored.select("row_id", "date", "label", "raw")


@query("i18_baselines")
def baselines(t: Tables):
    table = rows(t)
    specs = {
        "random_forest": ml.Spec(FEATURES, kind="random_forest", params={"trees": 5, "depth": 4}),
        "logistic": ml.Spec(FEATURES, kind="logistic", params={"rounds": 10}),
        "index_only": ml.Spec(("price",), kind="logistic", params={"rounds": 10}),
    }
    from gridrisk.operators.ranking import union_all

    return union_all(
        [
            evl.scores(
                ml.fit_holdout(table, spec, F.col("year") < 2000), "label", "raw"
            ).withColumn("model", F.lit(name))
            for name, spec in specs.items()
        ]
    ).select("model", "auprc", "auroc", "brier", "lift")


@query("i19_stacked_score")
def stacked_score(t: Tables):
    """A base model of the orders table scores the lines as one more feature."""
    base_rows = t.orders.select(
        F.col("o_totalprice").alias("value"),
        F.month("o_orderdate").cast("double").alias("when"),
        (F.col("o_orderstatus") == "F").cast("int").alias("base_label"),
    )
    base = ml.Spec(("value", "when"), label="base_label", params=QUICK)
    table = rows(t)
    columns = {"value": F.col("price"), "when": F.col("month")}
    stacked = ml.stacked_score(base_rows, base, table, columns, "base_score")
    spec = ml.Spec((*FEATURES, "base_score"), params=QUICK)
    held_out = ml.fit_holdout(stacked, spec, F.col("year") < 2000)
    return evl.scores(held_out, "label", "raw").select("auprc", "auroc", "brier", "lift")


SPACE = {"depth": tn.Range(2, 3, whole=True), "step": tn.Range(0.05, 0.4, log=True)}
DRAWN = "CAST('0x' || substr(md5('5|{name}|' || CAST(trial AS VARCHAR)), 1, 15) AS BIGINT) / 1152921504606846976e0"


@query(
    "i20_search",
    f"WITH t AS (SELECT CAST(unnest(range(0, 2)) AS INT) AS trial), d AS (SELECT trial, least(3, floor(2 + {DRAWN.format(name='depth')} * 2)) AS depth, exp(ln(5e-2) + {DRAWN.format(name='step')} * (ln(4e-1) - ln(5e-2))) AS step FROM t) "
    "SELECT trial, CAST(depth AS DOUBLE) AS depth, round(step, 9) AS step, true AS settled, true AS scored, CAST(1 AS BIGINT) AS best_of_each, concat_ws(',', 'depth', CASE WHEN least(step - 5e-2, 4e-1 - step) <= 2e-2 * 35e-2 THEN 'step' END) AS on_boundary FROM d",
)
def search(t: Tables):
    """Two trials over two year folds, up to four rounds; what the learner does not decide is checked."""
    trials = tn.draw_trials(SPACE, 2, 5)
    table = tn.trial_table(rows(t), SPEC, trials, "fold", 2, rounds=4, patience=2)
    bests = {o: tn.best_trial(table, o)["trial"] for o in tn.OBJECTIVES}
    near = F.lit(",".join(tn.on_the_boundary(trials[0], SPACE)))
    for k, params in enumerate(trials):
        near = F.when(F.col("trial") == k, F.lit(",".join(tn.on_the_boundary(params, SPACE)))).otherwise(near)
    scored = F.col("pooled_auprc").between(0, 1) & F.col("fold_auroc").between(0, 1) & (F.col("fold_lift") > 0) & (F.col("fold_neg_log_loss") < 0)
    return table.select(
        "trial", "depth", F.round("step", 9).alias("step"), F.col("rounds").between(1, 4).alias("settled"), scored.alias("scored"),
        F.lit(len({o for o in bests if bests[o] in range(2)}) // len(tn.OBJECTIVES)).cast("long").alias("best_of_each"), near.alias("on_boundary"),
    )


@query("i21_block_ablation")
def block_ablation(t: Tables):
    blocks = {"price": ("price",), "rates": ("discount", "tax")}
    spec = ml.Spec(FEATURES, params={"rounds": 2, "depth": 3})
    return ml.ablation(rows(t), spec, blocks, "fold", 2)


@query("i23_sampling_variants")
def sampling_variants(t: Tables):
    """Negatives at one and two per positive beside all of them."""
    table = rows(t)
    variants = {"all": table}
    for ratio in (1, 2):
        drawn = repeated_draws(table, "label", "row_id", ratio, 1, 9)
        variants[f"ratio_{ratio}"] = drawn.drop("draw")
    spec = ml.Spec(FEATURES, params={"rounds": 2, "depth": 3})
    out = ml.run_variants(variants, spec, "fold", 2)
    return out.select("variant", "auprc", "auroc", "positive_rate", "lift")


RETRAINED = {
    "reference": va.Variant(),
    "recency": va.Variant(half_life=2.0),
    "half_life_20": va.Variant(half_life=20.0),
    "half_life_10": va.Variant(half_life=10.0),
    "half_life_5": va.Variant(half_life=5.0),
    "from_1996": va.Variant(first_year=1996),
    "from_1998": va.Variant(first_year=1998),
    "no_rates": va.Variant(numeric=("quantity", "price", "month")),
}


@query("i24_retraining_variants")
def retraining_variants(t: Tables):
    """With the library's own rounds, folds and resamples; years before 2000 are learnt from."""
    table = rows(t).drop("fold")
    return va.variant_axis(table, ml.Spec(FEATURES), RETRAINED, F.col("year") < 2000, 1999, "reference", "date", "cell_id")


PERIODS = ((1995, 1997), (1998, 2001))


@query("i25_period_transfer")
def period_transfer(t: Tables):
    table = rows(t).withColumn("period", period_label(F.col("year"), PERIODS))
    folds = evl.group_folds(table, "date", 2, 3)
    days = cut_lineage(table.drop("fold").join(folds, "date"), "days")
    labels = [f"{a}-{b}" for a, b in PERIODS]
    spec = ml.Spec(FEATURES, params={"rounds": 3, "depth": 3})
    out = ml.transfer_matrix(days, spec, "period", labels, "fold", 2)
    return out.select("trained_on", "scored_on", "auprc", "auroc", "lift")


@query("i25_forward_scan")
def forward_scan(t: Tables):
    spec = ml.Spec(FEATURES, params={"rounds": 3, "depth": 3})
    out = ml.forward_scan(rows(t), spec, "year", (1995, 1997, 1999), 2000)
    return out.select("first_year", "auprc", "auroc", "lift")


@query("i27_adversarial")
def adversarial(t: Tables):
    table = rows(t).drop("fold")
    spec = ml.Spec(FEATURES, params={"rounds": 3, "depth": 3})
    quality, importances = ml.adversarial(
        table, spec, F.col("year") >= 1999, "date", 2, 3
    )
    top = importances[0]
    return quality.select(
        "auroc",
        "positive_rate",
        F.lit(top[0]).alias("top_feature"),
        F.lit(top[1]).alias("top_importance"),
    )


SCORED_FROM, SCORED_DAYS = "2000-01-01", 366


@query(
    "i29_fitted_days",
    "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_orderkey % 17 > 0 THEN l_quantity END AS quantity FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' AND l_shipdate < DATE '2001-01-01') "
    "SELECT date, count(*) AS cells, count(*) FILTER (quantity IS NULL) AS without_quantity, true AS loaded_agrees, true AS ranks_follow, true AS probabilities_follow FROM d GROUP BY date",
)
def fitted_days(t: Tables):
    """A model of the years before 2000, saved, loaded, and applied to every row of the next year.

    What does not depend on the learner is checked: the loaded model gives the fresh one's scores,
    and rank and probability rise with the raw score within each day.
    """
    from pyspark.sql import Window

    from gridrisk.plans import shipped as sh
    from gridrisk.session import fresh_path

    table = rows(t)
    fresh = sh.ship(table.where("year < 2000"), SPEC, "fold", 2, log_offset=-3.0, window_offset=0.2)
    path = fresh_path(t.spark, "shipped-model")
    fresh.save(t.spark, path)
    loaded = sh.Shipped.load(t.spark, path)
    later = table.where("year >= 2000")
    scored = sh.scored_days(later, loaded, SCORED_FROM, SCORED_DAYS, FEATURES, ["row_id"])
    named = scored.withColumnRenamed("probability", "chance").withColumn("label", F.lit(0))
    both = ml.predict(fresh.model, named, SPEC, "fresh").withColumnRenamed("chance", "probability")
    day = Window.partitionBy("date").orderBy("raw")
    step = both.withColumns({f"_{c}": F.col(c) - F.lag(c).over(day) for c in ("raw", "rank", "probability")})
    first = F.col("_rank").isNull()
    return step.groupBy("date").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("quantity").isNull()).alias("without_quantity"),
        F.bool_and(F.col("raw") == F.col("fresh")).alias("loaded_agrees"),
        F.bool_and(first | ((F.col("_raw") > 0) == (F.col("_rank") > 0))).alias("ranks_follow"),
        F.bool_and(first | (F.col("_probability") >= 0)).alias("probabilities_follow"),
    )
