"""Scores of a rare-event model: ranking metrics, reliability, folds and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.functions.hashing import draw_key
from gridrisk.operators.joins import with_scalars
from gridrisk.operators.ordering import exact_percentiles, running_sums


def _score_classes(
    df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column | None = None
) -> DataFrame:
    """One row per group and distinct score with its rows and hits, from the highest down."""
    w = weight if weight is not None else F.lit(1)
    return df.groupBy(*by, (-F.col(score)).alias("_down")).agg(
        F.sum(w).cast("double").alias("_n"),
        F.sum(w * F.col(label)).cast("double").alias("_hit"),
        F.sum(w * F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("_square"),
    )


def scores(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Average precision, area under the ROC, Brier score, base rate and lift.

    Rows collapse to distinct scores first, and the running counts over those are sliced, so a
    group of any size is ranked without one task holding it.
    """
    classes = _score_classes(df, by, label, score, weight).where(F.col("_n") > 0)
    placed = running_sums(classes, by, "_down", ["_n", "_hit", "_square"])
    hit, n = F.col("_hit"), F.col("_n")
    cum_hit, cum_n = F.col("cum__hit"), F.col("cum__n")
    positives, rows = F.col("total__hit"), F.col("total__n")
    miss, cum_miss = n - hit, cum_n - cum_hit
    negatives = rows - positives
    out = [
        F.sum(F.try_divide(hit, positives) * cum_hit / cum_n).alias("auprc"),
        # a positive beats the negatives further down, and ties count half
        F.sum(F.try_divide(hit * (negatives - cum_miss + miss / 2.0), positives * negatives)).alias(
            "auroc"
        ),
        F.max(F.col("total__square") / rows).alias("brier"),
        F.max(positives / rows).alias("positive_rate"),
        F.max(rows).alias("rows"),
    ]
    table = placed.groupBy(*by).agg(*out) if by else placed.agg(*out)
    return table.withColumn("lift", F.try_divide(F.col("auprc"), F.col("positive_rate")))


def log_loss(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), balanced: bool = True
) -> DataFrame:
    """Log loss with the classes given equal weight."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    y = F.col(label)
    loss = -(F.when(y == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p)))
    per_class = (F.avg(F.when(y == 1, loss)) + F.avg(F.when(y == 0, loss))) / 2.0
    out = (per_class if balanced else F.avg(loss)).alias("log_loss")
    return df.groupBy(*by).agg(out) if by else df.agg(out)


def curve_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision-recall and ROC points, one per distinct score, from the highest down."""
    classes = _score_classes(df, by, label, score)
    placed = running_sums(classes, by, "_down", ["_n", "_hit"])
    cum_hit, cum_n = F.col("cum__hit"), F.col("cum__n")
    negatives = F.col("total__n") - F.col("total__hit")
    return placed.select(
        *by,
        (-F.col("_down")).alias("threshold"),
        (cum_hit / cum_n).alias("precision"),
        F.try_divide(cum_hit, F.col("total__hit")).alias("recall"),
        F.try_divide(cum_n - cum_hit, negatives).alias("false_positive_rate"),
    )


def reliability(
    df: DataFrame, label: str, score: str, n_bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Predicted against observed frequency over quantile bins, repeated edges merged.

    The edges are `n_bins` + 1 exact quantiles, so the broadcast array per group is that long. A
    score on an edge belongs to the bin the edge closes.
    """
    edges = exact_percentiles(df, by, score, rungs=n_bins + 1)
    packed = F.array_sort(F.collect_set("value")).alias("_edges")
    bounds = edges.groupBy(*by).agg(packed) if by else edges.agg(packed)
    joined = df.join(bounds, list(by)) if by else with_scalars(df, bounds)
    below = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    last = F.greatest(F.size("_edges") - 2, F.lit(0))
    bin_of = F.least(F.greatest(below - 1, F.lit(0)), last)
    return joined.groupBy(*by, bin_of.alias("bin")).agg(
        F.count("*").alias("count"),
        F.avg(score).alias("predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count-weighted mean gap between predicted and observed."""
    gap = F.sum(F.col("count") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("count")
    return bins.groupBy(*by).agg(gap.alias("ece")) if by else bins.agg(gap.alias("ece"))


def year_folds(df: DataFrame, year: str, n_folds: int, out: str = "fold") -> DataFrame:
    """Distinct years in contiguous blocks of near-equal length, the longer ones first.

    The window runs over one row per year of record.
    """
    years = df.select(year).distinct()
    return years.withColumn(out, F.ntile(n_folds).over(Window.orderBy(year)) - 1)


def block_id(df: DataFrame, x: str, y: str, size: float, out: str = "block") -> DataFrame:
    """Number of the square block a point lies in, counted from the lowest corner."""
    bx, by = F.floor(F.col(x) / F.lit(size)), F.floor(F.col(y) / F.lit(size))
    ends = df.agg(F.min(bx).alias("_x0"), F.max(bx).alias("_x1"), F.min(by).alias("_y0"))
    width = F.col("_x1") - F.col("_x0") + 1
    joined = with_scalars(df, ends)
    return joined.withColumn(
        out, (by - F.col("_y0")) * width + (bx - F.col("_x0"))
    ).drop("_x0", "_x1", "_y0")


def group_folds(
    df: DataFrame, group: str, n_folds: int, seed: int, out: str = "fold"
) -> DataFrame:
    """Whole groups dealt to folds of near-equal number, in the order of a seeded hash."""
    from gridrisk.operators.ordering import row_ids

    groups = df.select(group).distinct().withColumn("_key", draw_key(seed, F.col(group)))
    placed = row_ids(groups, [F.col("_key"), F.col(group)], "_place")
    total = groups.agg(F.count("*").alias("_n"))
    joined = with_scalars(placed, total)
    # the first n mod k folds take one group more
    small = F.floor(F.col("_n") / n_folds)
    extra = F.col("_n") % n_folds
    edge = extra * (small + 1)
    fold = F.when(F.col("_place") < edge, F.floor(F.col("_place") / (small + 1))).otherwise(
        extra + F.floor((F.col("_place") - edge) / F.greatest(small, F.lit(1)))
    )
    return joined.select(group, fold.cast("int").alias(out))


def intervals(replicates: DataFrame, metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of each metric; one row per replicate comes in."""
    tail = (1.0 - level) / 2
    cut = F.array(F.lit(tail), F.lit(1.0 - tail))
    stats = replicates.agg(
        *(F.percentile(m, cut).alias(m) for m in metrics), F.count("*").alias("resamples")
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(m).alias("metric"),
                F.get(m, F.lit(0)).alias("lo"),
                F.get(m, F.lit(1)).alias("hi"),
                F.col("resamples").alias("resamples"),
            )
            for m in metrics
        )
    )
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def positive_weight(df: DataFrame, label: str, weight: Column | None = None) -> DataFrame:
    """Weighted negatives over weighted positives, the weight a positive row trains with."""
    w = weight if weight is not None else F.lit(1.0)
    return df.agg(
        F.try_divide(
            F.sum(F.when(F.col(label) == 0, w)), F.sum(F.when(F.col(label) == 1, w))
        ).alias("positive_weight")
    )


def fixed_effects_slope(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares slope with one intercept per group, from sums per group alone."""
    sums = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
    )
    within = sums.agg(
        F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("xy"),
        F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("xx"),
        F.count("*").alias("groups"),
        F.sum("n").alias("rows"),
    )
    return within.select(
        F.try_divide(F.col("xy"), F.col("xx")).alias("slope"), "groups", "rows"
    )


def separation(
    df: DataFrame, label: str, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """How well each raw column alone tells the classes apart, per group."""
    packed = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)
    )
    long = df.select(*by, label, F.inline(packed)).where(F.col("value").isNotNull())
    return scores(long, label, "value", [*by, "column"]).select(
        *by, "column", "auroc", "rows"
    )


def not_reproduced(
    stored: DataFrame, again: DataFrame, keys: Sequence[str], value: str, tolerance: float
) -> DataFrame:
    """Keys whose recomputed value differs from the stored one, or is missing on one side."""
    joined = stored.select(*keys, F.col(value).alias("_a")).join(
        again.select(*keys, F.col(value).alias("_b")), list(keys), "full"
    )
    gap = F.col("_b") - F.col("_a")
    off = gap.isNull() | (F.abs(gap) > tolerance)
    return joined.where(off).select(*keys, gap.alias("gap"))
