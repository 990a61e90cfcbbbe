"""Section I without the learners: sampling, evaluation, calibration, verification."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridrisk.catalog.aggregates import EXCLUSION_SQL, SEASON_SQL, exclusion_inputs
from gridrisk.catalog.registry import query
from gridrisk.catalog.standins import (
    WITH_CELL_DAYS,
    WITH_FIRES,
    WITH_GRID,
    WITH_SCORES,
    Tables,
)
from gridrisk.functions import calendar, lookup, physics
from gridrisk.functions.statistics import garwood
from gridrisk.operators import bootstrap as bs
from gridrisk.operators import calibration as cal
from gridrisk.operators import evaluation as evl
from gridrisk.operators import events as ev
from gridrisk.operators import joins as jn
from gridrisk.operators import ordering
from gridrisk.operators import sampling as sm

FIRST, N_DAYS = "1995-01-01", 2557


def hash_sql(seed, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


POOL_SQL = (
    f"WITH {EXCLUSION_SQL}, {WITH_GRID}, a AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS position FROM grid WHERE is_active), "
    f"t AS (SELECT count(*) * {N_DAYS} AS total, count(*) AS n_cells FROM a), x AS (SELECT DISTINCT position * {N_DAYS} + date_diff('day', DATE '{FIRST}', date) AS flat FROM pairs JOIN a USING (cell_id) "
    f"WHERE date_diff('day', DATE '{FIRST}', date) BETWEEN 0 AND {N_DAYS - 1}), "
)


@query(
    "i01_uniform_negatives",
    POOL_SQL + "k AS (SELECT count(*) FILTER (is_active) * 10 AS n FROM grid), "
    f"d AS (SELECT i AS attempt, {hash_sql(7, 'i')} % (SELECT total FROM t) AS flat FROM range(0, (SELECT n * 3 FROM k)) r(i)), "
    "f AS (SELECT flat, min(attempt) AS attempt FROM d GROUP BY flat), g AS (SELECT flat, row_number() OVER (ORDER BY attempt) AS place FROM f WHERE flat NOT IN (SELECT flat FROM x)) "
    f"SELECT cell_id, CAST(DATE '{FIRST}' + CAST(flat % {N_DAYS} AS INT) AS DATE) AS date FROM g JOIN a ON a.position = flat // {N_DAYS} WHERE place <= (SELECT n FROM k)",
)
def uniform_negatives(t: Tables):
    _, pairs = exclusion_inputs(t)
    active = t.grid().where("is_active")
    wanted = 10 * active.count()
    return sm.sample_negatives(active, pairs, wanted, FIRST, N_DAYS, 7).select("cell_id", "date")


@query(
    "i02_matched_negatives",
    POOL_SQL + "p AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id, ignition_date, fire_id) - 1 AS row FROM fires WHERE cell_id IN (SELECT cell_id FROM a) AND cause = 10), "
    f"k AS (SELECT count(*) AS n FROM p), d AS (SELECT i AS attempt, {hash_sql('7-row', 'i')} % (SELECT n FROM k) AS row, {hash_sql('7-day', 'i')} % {N_DAYS} AS day_offset FROM range(0, (SELECT n * 4 + 256 FROM k)) r(i)), "
    f"e AS (SELECT attempt, position * {N_DAYS} + day_offset AS flat FROM d JOIN p USING (row) JOIN a USING (cell_id)), f AS (SELECT flat, min(attempt) AS attempt FROM e GROUP BY flat), "
    "g AS (SELECT flat, row_number() OVER (ORDER BY attempt) AS place FROM f WHERE flat NOT IN (SELECT flat FROM x)) "
    f"SELECT cell_id, CAST(DATE '{FIRST}' + CAST(flat % {N_DAYS} AS INT) AS DATE) AS date FROM g JOIN a ON a.position = flat // {N_DAYS} WHERE place <= (SELECT n FROM k)",
)
def matched_negatives(t: Tables):
    _, pairs = exclusion_inputs(t)
    active = t.grid().where("is_active")
    positives = (
        t.fires()
        .where("cause = 10")
        .select("cell_id", F.struct("ignition_date", "fire_id").alias("date"))
    )
    wanted = positives.join(active, "cell_id", "left_semi").count()
    return sm.matched_negatives(positives, active, pairs, wanted, FIRST, N_DAYS, 7).select(
        "cell_id", "date"
    )


@query(
    "i03_stratified_sample",
    f"WITH {WITH_SCORES}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(11, 'row_id')}, row_id) AS k FROM scores) "
    "SELECT row_id, label FROM r WHERE k <= 2000",
)
def stratified_sample(t: Tables):
    rows = t.scores().select("row_id", "label")
    return sm.stratified_sample(rows, ["label"], "row_id", 2000, 11)


@query(
    "i03_size_matched",
    f"WITH {WITH_SCORES}, n AS (SELECT year, label, count(*) AS n FROM scores GROUP BY 1, 2), s AS (SELECT label, min(n) AS size FROM n GROUP BY 1), "
    f"r AS (SELECT year, row_id, label, row_number() OVER (PARTITION BY year, label ORDER BY {hash_sql(11, 'row_id')}, row_id) AS k FROM scores) "
    "SELECT year, label, count(*) AS n, CAST(sum(row_id % 1000) AS BIGINT) AS fingerprint FROM r JOIN s USING (label) WHERE k <= size GROUP BY 1, 2",
)
def size_matched(t: Tables):
    rows = t.scores().select("year", "label", "row_id")
    out = sm.size_matched(rows, "year", "label", "row_id", 11)
    return out.groupBy("year", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("row_id") % 1000).alias("fingerprint")
    )


AP_SQL = (
    "c AS (SELECT {by} score, sum({w}) AS n, sum({w} * label) AS hit FROM {source} GROUP BY ALL), "
    "r AS (SELECT *, sum(hit) OVER w AS ch, sum(n) OVER w AS cn, sum(hit) OVER p AS p, sum(n) OVER p AS n_all FROM c WINDOW w AS ({part} ORDER BY score DESC), p AS ({part})) "
)
AP_OUT = (
    "sum(hit / p * ch / cn) AS auprc, sum(hit * ((n_all - p) - (cn - ch) + (n - hit) / 2e0)) / (any_value(p) * (any_value(n_all) - any_value(p))) AS auroc"
)


@query(
    "i04_repeated_draws",
    f"WITH {WITH_SCORES}, s AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scores), "
    f"d AS (SELECT draw, label, score FROM scores, range(0, 10) g(draw), s WHERE label = 1 OR {hash_sql(5, 'draw', 'row_id')} / 1152921504606846976e0 < least(1e0, p * 1 / q)), "
    + AP_SQL.format(by="draw,", w="1", source="d", part="PARTITION BY draw")
    + f"SELECT CAST(draw AS INT) AS draw, round(auprc, 8) AS auprc FROM (SELECT draw, {AP_OUT} FROM r GROUP BY draw)",
)
def repeated_draws(t: Tables):
    drawn = sm.repeated_draws(t.scores(), "label", "row_id", 1, 10, 5)
    out = evl.scores(drawn, "label", "score", ["draw"])
    return out.select("draw", F.round("auprc", 8).alias("auprc"))


@query(
    "i04_fixed_ratio",
    f"WITH {WITH_SCORES}, n AS (SELECT year, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scores GROUP BY year), k AS (SELECT year, least(p, q // 10) AS k FROM n) "
    "SELECT CAST(year AS INT) AS year, CAST(200 AS BIGINT) AS draws, CAST(k AS BIGINT) AS positives, CAST(k * 10 AS BIGINT) AS negatives, true AS ratio_kept, true AS in_order FROM k WHERE year IN (1996, 2000)",
)
def fixed_ratio(t: Tables):
    """Two hundred draws at one positive to ten negatives; the counts of every draw are checked."""
    from gridrisk.operators.ranking import union_all

    tables = []
    for year in (1996, 2000):
        drawn = bs.fixed_ratio_draws(t.scores().where(F.col("year") == year), "label", "score", seed=5)
        cuts = F.percentile("auprc", F.array(F.lit(0.025), F.lit(0.975)))
        row = drawn.agg(
            F.count("*").alias("draws"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
            F.bool_and((F.col("negatives") == 10 * F.col("positives")) & (F.col("positives") > 0)).alias("ratio_kept"),
            F.avg("auprc").alias("mean"), cuts.alias("cuts"), F.min("positives").alias("least"),
        )
        held = F.col("ratio_kept") & (F.col("least") == F.col("positives"))
        tables.append(row.select(F.lit(year).alias("year"), "draws", "positives", "negatives", held.alias("ratio_kept"), F.col("mean").between(F.col("cuts")[0], F.col("cuts")[1]).alias("in_order")))
    return union_all(tables)


@query(
    "i05_year_folds",
    f"WITH {WITH_SCORES}, y AS (SELECT DISTINCT year FROM scores) SELECT year, CAST(ntile(3) OVER (ORDER BY year) - 1 AS INT) AS fold FROM y",
)
def year_folds(t: Tables):
    return evl.year_folds(t.scores(), "year", 3)


BLOCK_SQL = (
    f"{WITH_GRID}, b AS (SELECT cell_id, floor(x / 2e3) AS bx, floor(y / 2e3) AS yb FROM grid), e AS (SELECT min(bx) AS x0, max(bx) AS x1, min(yb) AS y0 FROM b), "
    "blocks AS (SELECT cell_id, CAST((yb - y0) * (x1 - x0 + 1) + (bx - x0) AS BIGINT) AS block FROM b, e)"
)


@query(
    "i06_spatial_folds",
    f"WITH {BLOCK_SQL}, g AS (SELECT DISTINCT block FROM blocks), f AS (SELECT block, ntile(5) OVER (ORDER BY {hash_sql(42, 'block')}, block) - 1 AS fold FROM g) "
    "SELECT cell_id, block, CAST(fold AS INT) AS fold FROM blocks JOIN f USING (block)",
)
def spatial_folds(t: Tables):
    placed = evl.block_id(t.grid().select("cell_id", "x", "y"), "x", "y", 2000.0)
    folds = evl.group_folds(placed, "block", 5, 42)
    return placed.join(folds, "block").select("cell_id", "block", "fold")


@query(
    "i07_scores",
    f"WITH {WITH_SCORES}, "
    + AP_SQL.format(by="year,", w="1", source="scores", part="PARTITION BY year")
    + f", m AS (SELECT year, {AP_OUT} FROM r GROUP BY year), q AS (SELECT year, avg((score - label) * (score - label)) AS brier, avg(label) AS positive_rate, count(*) AS n FROM scores GROUP BY year) "
    "SELECT year, round(auprc, 8) AS auprc, round(auroc, 8) AS auroc, round(brier, 8) AS brier, round(positive_rate, 8) AS positive_rate, round(auprc / positive_rate, 6) AS lift FROM m JOIN q USING (year)",
)
def scores(t: Tables):
    out = evl.scores(t.scores(), "label", "score", ["year"])
    return out.select(
        "year",
        *(F.round(c, 8).alias(c) for c in ("auprc", "auroc", "brier", "positive_rate")),
        F.round("lift", 6).alias("lift"),
    )


@query(
    "i07_overall_scores",
    f"WITH {WITH_SCORES}, "
    + AP_SQL.format(by="", w="1", source="scores", part="")
    + f"SELECT round(auprc, 8) AS auprc, round(auroc, 8) AS auroc FROM (SELECT {AP_OUT} FROM r)",
)
def overall_scores(t: Tables):
    out = evl.scores(t.scores(), "label", "score")
    return out.select(F.round("auprc", 8).alias("auprc"), F.round("auroc", 8).alias("auroc"))


@query(
    "i07_balanced_log_loss",
    f"WITH {WITH_SCORES}, p AS (SELECT year, label, least(greatest(score, 1e-15), 1e0 - 1e-15) AS p FROM scores) "
    "SELECT year, round((avg(-ln(p)) FILTER (label = 1) + avg(-ln(1e0 - p)) FILTER (label = 0)) / 2, 8) AS log_loss FROM p GROUP BY year",
)
def balanced_log_loss(t: Tables):
    out = evl.log_loss(t.scores(), "label", "score", ["year"])
    return out.withColumn("log_loss", F.round("log_loss", 8))


PRIME = bs.PRIME
FACTOR, ADDEND = "'factor'", "'addend'"
RESAMPLE_SQL = (
    f"rep AS (SELECT replicate, 1 + {hash_sql(3, FACTOR, 'replicate')} % {PRIME - 1} AS f, {hash_sql(3, ADDEND, 'replicate')} % {PRIME} AS a FROM range(0, {bs.RESAMPLES}) g(replicate))"
)
# counts with the cumulative probability below each, for every mean there is
STEPS_SQL = (
    "m AS (SELECT n, k, coalesce(sum(p) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low "
    "FROM (SELECT n, k, exp(k * ln(n) - n - lgamma(k + 1)) AS p FROM (SELECT n, unnest(range(0, CAST(n + 12 * sqrt(n) + 40 AS BIGINT))) AS k FROM (SELECT DISTINCT n FROM classes))))"
)


@query(
    "i08_bootstrap_intervals",
    f"WITH {WITH_SCORES}, {RESAMPLE_SQL}, classes AS (SELECT score, label, count(*) AS n, any_value({hash_sql(3, 'label', 'score')} % {PRIME}) AS h FROM scores GROUP BY 1, 2), {STEPS_SQL}, "
    f"u AS (SELECT replicate, score, label, n, ((f * h + a) % {PRIME}) / {PRIME}e0 AS u FROM classes, rep), "
    "d AS (SELECT replicate, score, label, m.k AS copies FROM u ASOF JOIN m ON u.n = m.n AND u.u >= m.low), k AS (SELECT * FROM d WHERE copies > 0), "
    + AP_SQL.format(by="replicate,", w="copies", source="k", part="PARTITION BY replicate")
    + f", m2 AS (SELECT replicate, {AP_OUT}, any_value(p) / any_value(n_all) AS rate FROM r GROUP BY replicate) "
    "SELECT metric, round(quantile_cont(v, 25e-3), 6) AS lo, round(quantile_cont(v, 975e-3), 6) AS hi, count(*) AS resamples FROM ("
    "SELECT 'auprc' AS metric, auprc AS v FROM m2 UNION ALL SELECT 'auroc', auroc FROM m2 UNION ALL SELECT 'lift', auprc / rate FROM m2) GROUP BY metric",
)
def bootstrap_intervals(t: Tables):
    drawn = bs.score_resamples(t.scores(), "label", "score", seed=3)
    out = evl.intervals(drawn, ["auprc", "auroc", "lift"])
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query(
    "i09_paired_median_gap",
    f"WITH {WITH_CELL_DAYS}, {RESAMPLE_SQL}, classes AS (SELECT DISTINCT date, 1 AS n, {hash_sql(3, 'date')} % {PRIME} AS h FROM cell_days), {STEPS_SQL}, "
    f"u AS (SELECT replicate, date, n, ((f * h + a) % {PRIME}) / {PRIME}e0 AS u FROM classes, rep), "
    "w AS (SELECT replicate, date, m.k AS copies FROM u ASOF JOIN m ON u.n = m.n AND u.u >= m.low), "
    "v AS (SELECT date, raw, count(*) AS n FROM cell_days GROUP BY 1, 2), x AS (SELECT replicate, raw, sum(copies * v.n) AS n FROM v JOIN w USING (date) WHERE copies > 0 GROUP BY 1, 2), "
    "r AS (SELECT replicate, raw, sum(n) OVER (PARTITION BY replicate ORDER BY raw) AS upto, sum(n) OVER (PARTITION BY replicate) AS total FROM x), "
    "e AS (SELECT replicate, min(raw) FILTER (upto > (total - 1) // 2) AS lo, min(raw) FILTER (upto > total // 2) AS hi FROM r GROUP BY replicate) "
    # the second column is the square of the first, which keeps the order
    "SELECT CAST(replicate AS INT) AS replicate, round((lo * lo + hi * hi) / 2 - (lo + hi) / 2, 8) AS gap FROM e",
)
def paired_median_gap(t: Tables):
    rows = t.cell_days().withColumn("other", F.col("raw") * F.col("raw"))
    out = bs.paired_median_gaps(rows, "date", "raw", "other", seed=3)
    return out.withColumn("gap", F.round("gap", 8))


EDGES_SQL = (
    "e AS (SELECT list_sort(list_distinct(quantile_cont(score, [i / 1e1 FOR i IN range(0, 11)]))) AS edges FROM scores), "
    "b AS (SELECT label, score, least(greatest(len(list_filter(edges, lambda q: q < score)) - 1, 0), len(edges) - 2) AS bin FROM scores, e)"
)


@query(
    "i10_reliability",
    f"WITH {WITH_SCORES}, {EDGES_SQL} SELECT CAST(bin AS INT) AS bin, count(*) AS count, round(avg(score), 8) AS predicted, round(avg(label), 8) AS observed FROM b GROUP BY bin",
)
def reliability(t: Tables):
    bins = evl.reliability(t.scores(), "label", "score", 10)
    return bins.withColumns(
        {"predicted": F.round("predicted", 8), "observed": F.round("observed", 8)}
    )


@query(
    "i10_calibration_error",
    f"WITH {WITH_SCORES}, {EDGES_SQL}, g AS (SELECT bin, count(*) AS n, avg(score) AS p, avg(label) AS o FROM b GROUP BY bin) SELECT round(sum(n * abs(p - o)) / sum(n), 8) AS ece FROM g",
)
def calibration_error(t: Tables):
    bins = evl.reliability(t.scores(), "label", "score", 10)
    return evl.calibration_error(bins).select(F.round("ece", 8).alias("ece"))


@query(
    "i11_isotonic_knots",
    f"WITH {WITH_SCORES}, c AS (SELECT score AS x, count(*) AS n, sum(label) AS h FROM scores GROUP BY 1), s AS (SELECT x, n, h, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(h) OVER (ORDER BY x) AS ch FROM c), "
    # the fit at i is the highest of the lowest means of the runs that begin at or before it and end at or after it
    "ab AS (SELECT a.i AS a, b.i AS b, (b.ch - a.ch + a.h) / (b.cn - a.cn + a.n) AS mean FROM s a JOIN s b ON a.i <= b.i), low AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM ab), "
    "f AS (SELECT i, max(low) AS fitted FROM low GROUP BY i), g AS (SELECT fitted, min(x) AS x1, max(x) AS x2, CAST(sum(n) AS DOUBLE) AS size, CAST(sum(h) AS DOUBLE) AS hits FROM f JOIN s USING (i) GROUP BY 1), "
    "y AS (SELECT x1, x2, size, hits, max((hits + 5e-1) / (size + 1)) OVER (ORDER BY fitted) AS y FROM g) SELECT DISTINCT unnest([x1, x2]) AS x, round(y, 12) AS y, size, hits FROM y",
)
def isotonic_knots(t: Tables):
    return cal.isotonic_knots(t.scores(), "label", "score").withColumn("y", F.round("y", 12))


KNOTS = ((0.05, 0.2, 0.5, 0.8), (0.01, 0.15, 0.4, 0.85))


@query(
    "i12_apply_calibrator",
    f"WITH {WITH_SCORES}, m AS (SELECT row_id, CASE WHEN score < 5e-2 THEN 1e-2 WHEN score < 2e-1 THEN 1e-2 + 14e-2 / 15e-2 * (score - 5e-2) WHEN score < 5e-1 THEN 15e-2 + 25e-2 / 3e-1 * (score - 2e-1) "
    "WHEN score < 8e-1 THEN 4e-1 + 45e-2 / 3e-1 * (score - 5e-1) ELSE 85e-2 END AS s FROM scores), z AS (SELECT row_id, s, ln(s / (1e0 - s)) - 9e0 AS z FROM m) "
    "SELECT row_id, round(s, 9) AS sample_rate, round(z, 9) AS record_logit, round(1e0 / (1e0 + exp(-(z + 4e-1))), 12) AS population_rate FROM z",
)
def apply_calibrator(t: Tables):
    sample, record, population = lookup.calibrated(
        F.col("score"), lookup.knots(*KNOTS), -9.0, 0.4
    )
    return t.scores().select(
        "row_id",
        F.round(sample, 9).alias("sample_rate"),
        F.round(record, 9).alias("record_logit"),
        F.round(population, 12).alias("population_rate"),
    )


@query(
    "i13_sampling_rate",
    f"WITH {EXCLUSION_SQL}, {WITH_GRID}, a AS (SELECT cell_id FROM grid WHERE is_active), x AS (SELECT DISTINCT cell_id, date FROM pairs WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND cell_id IN (SELECT cell_id FROM a)), "
    "n AS (SELECT (SELECT count(*) FROM a) * 2557 - (SELECT count(*) FROM x) AS pop, (SELECT count(*) FROM fires) AS drawn) "
    "SELECT drawn AS sampled_negatives, CAST(round_even(drawn * 25e-2, 0) AS BIGINT) AS matched_negatives, drawn - CAST(round_even(drawn * 25e-2, 0) AS BIGINT) AS uniform_negatives, "
    "round((drawn - round_even(drawn * 25e-2, 0)) / pop, 10) AS rate, round(ln((drawn - round_even(drawn * 25e-2, 0)) / pop), 8) AS log_offset FROM n",
)
def sampling_rate(t: Tables):
    _, pairs = exclusion_inputs(t)
    active = t.grid().where("is_active")
    out = cal.sampling_rate(active, pairs, "1995-01-01", "2001-12-31", t.fires(), 0.25)
    return out.select(
        "sampled_negatives",
        "matched_negatives",
        "uniform_negatives",
        F.round("rate", 10).alias("rate"),
        F.round("log_offset", 8).alias("log_offset"),
    )


# windows of the last years before 2000, and the years from then on that they are tried on
WINDOWS = ((2, 1998, 1999), (3, 1997, 1999), (5, 1995, 1999))
WINDOWS_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(map(str, WINDOWS)) + ") v(win, first, last))"
WINDOW_SQL = (
    f"WITH RECURSIVE {WITH_SCORES}, {WINDOWS_SQL}, l AS (SELECT year, label, ln(s / (1 - s)) AS z FROM (SELECT year, label, greatest(least(score, 1 - 1e-9), 1e-9) AS s FROM scores)), "
    "lw AS (SELECT win, label, z FROM l JOIN w ON year BETWEEN first AND last), record AS (SELECT avg(label) AS rate FROM l WHERE year < 2000), "
    "r AS (SELECT win, sum(label) AS ignitions, count(*) AS cell_days, avg(label) AS rate FROM lw GROUP BY win), k AS (SELECT win, z, count(*) AS n FROM lw GROUP BY ALL), "
    "b AS (SELECT win, rate, -2e1 AS lo, 2e1 AS hi, 0 AS step FROM r UNION ALL SELECT b.win, any_value(rate), CASE WHEN sum(n / (1 + exp(-z - (lo + hi) / 2))) / sum(n) < any_value(rate) THEN any_value((lo + hi) / 2) ELSE any_value(lo) END, "
    "CASE WHEN sum(n / (1 + exp(-z - (lo + hi) / 2))) / sum(n) < any_value(rate) THEN any_value(hi) ELSE any_value((lo + hi) / 2) END, any_value(step) + 1 FROM b JOIN k ON k.win = b.win WHERE step < 42 GROUP BY b.win), "
    "p AS (SELECT r.win, r.ignitions, r.cell_days, r.rate, ln(r.rate / record.rate) AS prior_shift, (SELECT any_value((lo + hi) / 2) FROM b WHERE b.win = r.win AND step = 42) AS matched_shift FROM r, record), "
    "m AS (SELECT p.win, sum(n / (1 + exp(-z))) / sum(n) AS mean_before, sum(n / (1 + exp(-z - prior_shift))) / sum(n) AS mean_prior FROM p JOIN k ON k.win = p.win GROUP BY p.win), "
    # a mean lies in the interval when neither tail beyond the count is under 2.5 % with it
    "t AS (SELECT m.win, sum(CASE WHEN i <= ignitions THEN q ELSE 0 END) AS below, sum(CASE WHEN i < ignitions THEN q ELSE 0 END) AS under FROM (SELECT m.win, ignitions, i, exp(i * ln(mean_prior * cell_days) - mean_prior * cell_days - lgamma(i + 1)) AS q "
    "FROM m JOIN p ON p.win = m.win, range(0, (SELECT CAST(max(ignitions) AS BIGINT) + 1 FROM r)) g(i)) m GROUP BY m.win), "
    "c AS (SELECT p.*, mean_before, mean_prior, below >= 25e-3 AND 1 - under >= 25e-3 AS prior_fits FROM p JOIN m ON m.win = p.win JOIN t ON t.win = p.win), "
    "choice AS (SELECT *, CASE WHEN prior_fits THEN prior_shift ELSE matched_shift END AS shift FROM c) "
)


def window_inputs(t: Tables):
    rows = cal.record_logits(t.scores(), "score").select("year", "label", "z")
    windows = t.spark.createDataFrame(WINDOWS, "window int, first int, last int")
    yearly = rows.groupBy("year").agg(F.sum("label").alias("ignitions"), F.count("*").alias("cell_days"))
    rates = cal.window_rates(yearly, windows)
    years = windows.select("window", F.explode(F.sequence("first", "last")).alias("year"))
    record = rows.where("year < 2000").agg(F.avg("label").alias("rate"))
    return rows, cal.window_choice(rows.join(years, "year").select("window", "z"), rates, record)


@query(
    "i14_window_shift",
    WINDOW_SQL + "SELECT win AS window_years, CAST(ignitions AS BIGINT) AS ignitions, cell_days, round(rate, 9) AS rate, round(prior_shift, 6) AS prior_shift, round(matched_shift, 6) AS matched_shift, round(mean_before, 9) AS mean_before, round(mean_prior, 9) AS mean_prior, prior_fits, round(shift, 6) AS shift FROM choice",
)
def window_shift(t: Tables):
    _, choice = window_inputs(t)
    return choice.select(
        F.col("window").alias("window_years"), "ignitions", "cell_days", F.round("rate", 9).alias("rate"),
        *(F.round(c, 6).alias(c) for c in ("prior_shift", "matched_shift")),
        *(F.round(c, 9).alias(c) for c in ("mean_before", "mean_prior")), "prior_fits", F.round("shift", 6).alias("shift"),
    )


@query(
    "i14_validated_windows",
    WINDOW_SQL.rstrip() + ", later AS (SELECT z, count(*) AS n, sum(label) AS h FROM l WHERE year >= 2000 GROUP BY z), o AS (SELECT sum(h) / sum(n) AS observed FROM later) "
    "SELECT win AS window_years, round(any_value(observed), 9) AS observed, round(sum(n / (1 + exp(-z - shift))) / sum(n), 8) AS predicted, round(sum(n / (1 + exp(-z - prior_shift))) / sum(n), 8) AS predicted_prior, "
    "round(sum(n / (1 + exp(-z - matched_shift))) / sum(n), 8) AS predicted_matched, round(sum(n / (1 + exp(-z))) / sum(n), 8) AS unshifted FROM choice, later, o GROUP BY win",
)
def validated_windows(t: Tables):
    rows, choice = window_inputs(t)
    later = rows.where("year >= 2000")
    seen = later.agg(F.sum("label").alias("ignitions"), F.count("*").alias("cell_days")).withColumn("_b", garwood("ignitions"))
    per_day = [(F.col(c) / F.col("cell_days")).alias(n) for c, n in (("ignitions", "rate"), ("_b.low", "low"), ("_b.high", "high"))]
    out = cal.validated_windows(choice, later.select("z"), seen.select(*per_day))
    return out.select(
        F.col("window").alias("window_years"), F.round("observed", 9).alias("observed"),
        *(F.round(c, 8).alias(c) for c in ("predicted", "predicted_prior", "predicted_matched", "unshifted")),
    )


@query(
    "i15_positive_weight",
    f"WITH {WITH_SCORES} SELECT round(sum(pow(5e-1, (2001 - year) / 3e0)) FILTER (label = 0) / sum(pow(5e-1, (2001 - year) / 3e0)) FILTER (label = 1), 8) AS positive_weight FROM scores",
)
def positive_weight(t: Tables):
    weight = physics.recency_weight(F.col("year"), 2001, 3.0)
    out = evl.positive_weight(t.scores(), "label", weight)
    return out.select(F.round("positive_weight", 8).alias("positive_weight"))


@query(
    "i22_shifted_labels",
    f"WITH {WITH_FIRES}, s AS (SELECT fire_id AS sample_id, cell_id, ignition_date AS date, cause >= 6 AS is_fire, CASE WHEN cause >= 6 THEN fire_id END AS fire_id, start_hour FROM fires), "
    "m AS (SELECT sample_id, cell_id, date + CASE WHEN is_fire AND start_hour >= 22 THEN 1 WHEN is_fire AND start_hour < 2 THEN -1 ELSE 0 END AS date, is_fire FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, date ORDER BY is_fire DESC, sample_id) AS k FROM m WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-07-31') "
    "SELECT sample_id, cell_id, date, is_fire FROM r WHERE k = 1",
)
def shifted_labels(t: Tables):
    fires = t.fires()
    hit = F.col("cause") >= 6
    samples = fires.select(
        F.col("fire_id").alias("sample_id"),
        "cell_id",
        F.col("ignition_date").alias("date"),
        hit.alias("is_fire"),
        F.when(hit, F.col("fire_id")).alias("fire_id"),
    )
    out = ev.shift_near_midnight(samples, fires, "1995-01-01", "2001-07-31")
    return out.select("sample_id", "cell_id", "date", "is_fire")


@query(
    "i26_fixed_effects_slope",
    "WITH g AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1) "
    "SELECT round(sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) * (l_quantity - mx)), 6) AS slope, count(DISTINCT l_suppkey) AS groups, count(*) AS rows FROM lineitem JOIN g USING (l_suppkey)",
)
def fixed_effects_slope(t: Tables):
    out = evl.fixed_effects_slope(t.lineitem, "l_suppkey", "l_quantity", "l_extendedprice")
    return out.withColumn("slope", F.round("slope", 6))


def _auroc_sql(column: str) -> str:
    return (
        f"SELECT l_linenumber AS kind, '{column}' AS \"column\", rank() OVER (PARTITION BY l_linenumber ORDER BY {column}) + (count(*) OVER (PARTITION BY l_linenumber, {column}) - 1) / 2e0 AS r, "
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"
    )


@query(
    "i28_separation",
    f"WITH r AS ({_auroc_sql('l_quantity')} UNION ALL {_auroc_sql('l_extendedprice')}) SELECT kind, \"column\", "
    "round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label))), 8) AS auroc FROM r GROUP BY 1, 2",
)
def separation(t: Tables):
    rows = t.lineitem.select(
        F.col("l_linenumber").alias("kind"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        "l_quantity",
        "l_extendedprice",
    )
    out = evl.separation(rows, "label", ["l_quantity", "l_extendedprice"], ["kind"])
    return out.select("kind", "column", F.round("auroc", 8).alias("auroc"))


@query(
    "i30_event_verification",
    f"WITH {WITH_CELL_DAYS}, {WITH_FIRES}, r AS (SELECT cell_id, date, raw, (rank() OVER (PARTITION BY date ORDER BY raw) + (count(*) OVER (PARTITION BY date, raw) - 1) / 2e0) / count(*) OVER (PARTITION BY date) AS pct FROM cell_days), "
    f"e AS (SELECT fire_id, f.cell_id, ignition_date AS date, {SEASON_SQL.replace('date', 'ignition_date')} AS season, raw, pct FROM fires f JOIN r ON r.cell_id = f.cell_id AND r.date = f.ignition_date) "
    "SELECT season, count(*) AS events, round(median(pct), 8) AS median_percentile, round(avg(pct), 8) AS mean_percentile, round(avg(CASE WHEN pct >= 9e-1 THEN 1e0 ELSE 0e0 END), 8) AS share_90, "
    "round(avg(CASE WHEN pct >= 99e-2 THEN 1e0 ELSE 0e0 END), 8) AS share_99 FROM e GROUP BY GROUPING SETS ((), (season))",
)
def event_verification(t: Tables):
    from gridrisk.plans.verification import verify_events

    events = t.fires().select("fire_id", "cell_id", F.col("ignition_date").alias("date"))
    summary = verify_events(events, t.cell_days().select("cell_id", "date", "raw"))
    return summary.select(
        "season",
        "events",
        *(
            F.round(c, 8).alias(c)
            for c in ("median_percentile", "mean_percentile", "share_90", "share_99")
        ),
    )


@query(
    "i30_event_classes",
    f"WITH {WITH_CELL_DAYS}, {WITH_FIRES}, q AS (SELECT quantile_cont(raw, [5e-1, 8e-1, 95e-2, 99e-2]) AS b FROM cell_days), e AS (SELECT len(list_filter(b, lambda x: x <= raw)) AS class FROM fires f JOIN cell_days d ON d.cell_id = f.cell_id AND d.date = f.ignition_date, q), "
    "k AS (SELECT unnest([0, 1, 2, 3, 4]) AS class, unnest(['very_low', 'low', 'moderate', 'high', 'very_high']) AS class_key) SELECT k.class, class_key, count(e.class) AS n FROM k LEFT JOIN e ON e.class = k.class GROUP BY 1, 2",
)
def event_classes(t: Tables):
    from gridrisk.operators.reports import class_histogram

    rows = t.cell_days()
    breaks = ordering.exact_percentiles(rows, (), "raw", [0.5, 0.8, 0.95, 0.99])
    packed = breaks.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rung", "value"))), lambda s: s["value"]
        ).alias("breaks")
    )
    events = t.fires().select("cell_id", F.col("ignition_date").alias("date"))
    found = jn.with_scalars(events.join(rows, ["cell_id", "date"]), packed)
    keys = ("very_low", "low", "moderate", "high", "very_high")
    return class_histogram(found, lookup.classify(F.col("raw"), F.col("breaks")), keys)


HOT_SQL = (
    f"{WITH_CELL_DAYS}, q AS (SELECT quantile_cont(raw, 95e-2) AS v FROM cell_days), h AS (SELECT cell_id, date, raw, date_diff('day', DATE '1995-01-01', date) AS day, cell_id // 10 AS row, cell_id % 10 AS col FROM cell_days, q WHERE raw >= v)"
)
REACH_SQL = (
    "reach AS (SELECT day, row, col, day AS d, row AS r, col AS c FROM h UNION SELECT reach.day, reach.row, reach.col, h.day, h.row, h.col FROM reach JOIN h ON abs(h.day - reach.d) <= 1 AND abs(h.row - reach.r) <= 1 AND abs(h.col - reach.c) <= 1), "
    "lab AS (SELECT day, row, col, min(struct_pack(d := d, r := r, c := c)) AS label FROM reach GROUP BY 1, 2, 3)"
)


def hot_rows(t: Tables):
    rows = t.cell_days()
    threshold = ordering.exact_percentiles(rows, (), "raw", [0.95]).select(
        F.col("value").alias("threshold")
    )
    hot = jn.with_scalars(rows, threshold).where(F.col("raw") >= F.col("threshold"))
    return hot.select(
        "cell_id",
        "date",
        "raw",
        F.date_diff("date", F.lit("1995-01-01").cast("date")).alias("day"),
        F.floor(F.col("cell_id") / 10).alias("row"),
        (F.col("cell_id") % 10).alias("col"),
    )


@query(
    "c21_connected_episodes",
    f"WITH RECURSIVE {HOT_SQL}, {REACH_SQL} SELECT day, row, col, label.d AS first_day, label.r AS first_row, label.c AS first_col FROM lab",
)
def connected_episodes(t: Tables):
    from gridrisk.operators.episodes import label_components

    labelled = label_components(hot_rows(t))
    return labelled.select(
        F.col("day").cast("bigint").alias("day"),
        "row",
        "col",
        F.col("episode.d").alias("first_day"),
        F.col("episode.r").alias("first_row"),
        F.col("episode.c").alias("first_col"),
    )


@query(
    "i31_extreme_episodes",
    f"WITH RECURSIVE {HOT_SQL}, {REACH_SQL}, n AS (SELECT label, row_number() OVER (ORDER BY label) AS episode FROM (SELECT DISTINCT label FROM lab)) "
    "SELECT episode, min(date) AS start, max(date) AS \"end\", count(DISTINCT cell_id) AS cells, count(*) AS cell_days, round(sum(raw), 9) AS expected FROM h JOIN lab USING (day, row, col) JOIN n USING (label) GROUP BY episode",
)
def extreme_episodes(t: Tables):
    from gridrisk.operators.episodes import label_components, number_episodes, summarize

    labelled = number_episodes(label_components(hot_rows(t)))
    events = t.orders.select(
        F.to_date("o_orderdate").alias("date"),
        F.col("o_custkey").alias("cell_id"),
        F.col("o_orderkey").alias("id"),
    )
    out = summarize(labelled.withColumn("probability", F.col("raw")), events)
    return out.select(
        "episode", "start", "end", "cells", "cell_days", F.round("expected", 9).alias("expected")
    )


@query(
    "i31_yearly_calibration",
    f"WITH RECURSIVE {HOT_SQL}, {REACH_SQL}, {WITH_FIRES}, x AS (SELECT year(date) AS year, label, raw FROM h JOIN lab USING (day, row, col)), "
    "k AS (SELECT year, count(*) AS known FROM fires GROUP BY year), i AS (SELECT f.year, count(*) AS seen FROM fires f JOIN h ON h.cell_id = f.cell_id AND h.date = f.ignition_date GROUP BY 1) "
    "SELECT CAST(x.year AS INT) AS year, count(DISTINCT label) AS episodes, count(*) AS cell_days, round(sum(raw), 9) AS expected, coalesce(any_value(known), 0) AS known_fires, coalesce(any_value(seen), 0) AS observed "
    "FROM x LEFT JOIN k USING (year) LEFT JOIN i USING (year) GROUP BY x.year",
)
def yearly_calibration(t: Tables):
    from gridrisk.operators.episodes import label_components, yearly_calibration as by_year

    labelled = label_components(hot_rows(t)).withColumn("probability", F.col("raw"))
    events = t.fires().select(
        "cell_id", F.col("ignition_date").alias("date"), F.lit("record").alias("origin")
    )
    out = by_year(labelled, events)
    return out.select(
        "year",
        "episodes",
        "cell_days",
        F.round("expected", 9).alias("expected"),
        "known_fires",
        "observed",
    )


@query(
    "i32_curve_points",
    f"WITH {WITH_SCORES}, "
    + AP_SQL.format(by="", w="1", source="scores", part="")
    + "SELECT score AS threshold, round(ch / cn, 9) AS precision, round(ch / p, 9) AS recall, round((cn - ch) / (n_all - p), 9) AS false_positive_rate FROM r",
)
def curve_points(t: Tables):
    out = evl.curve_points(t.scores(), "label", "score")
    return out.select(
        "threshold",
        *(F.round(c, 9).alias(c) for c in ("precision", "recall", "false_positive_rate")),
    )
