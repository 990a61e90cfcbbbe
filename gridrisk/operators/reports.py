"""Summaries and quality tables: coverage, balance, agreement, composition, attribution, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.functions.statistics import poisson_two_sided
from gridrisk.operators.joins import with_scalars
from gridrisk.operators.ordering import exact_percentiles, percentile_rank


def share_below(
    df: DataFrame, groups: Sequence[str], value: str, ceiling: float, out: str = "share"
) -> DataFrame:
    """Share of groups whose lowest value falls under the ceiling."""
    lowest = df.groupBy(*groups).agg(F.min(value).alias("_low"))
    return lowest.agg(F.avg((F.col("_low") < ceiling).cast("double")).alias(out))


def coverage_by_month(
    df: DataFrame, date: str, age: str, means: Sequence[str], bands: Sequence[str]
) -> DataFrame:
    """Per month of the record: rows, mean fractions, fresh and unusable shares, missing bands."""
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.count("*").alias("cells"),
        *(F.avg(m).alias(f"{m}_mean") for m in means),
        (F.count_if(F.col(age) == 0) / F.count("*")).alias("observed_share"),
        (F.count_if(F.col(age).isNull()) / F.count("*")).alias("unusable_share"),
        *((F.count_if(F.col(b).isNull()) / F.count("*")).alias(f"{b}_missing_share") for b in bands),
    )


def balance(df: DataFrame, group: str, positive: Column) -> DataFrame:
    n, hits = F.count("*"), F.count_if(positive)
    return df.groupBy(group).agg(
        n.alias("rows"),
        hits.alias("positives"),
        (n - hits).alias("negatives"),
        (hits / n).alias("positive_share"),
    )


def distributions(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing share, minimum, maximum, mean and sample deviation, one row per feature.

    One aggregate over the wide table, unpivoted afterwards, so the rows are not multiplied.
    """
    stats = []
    for f in features:
        stats += [
            (F.count_if(F.col(f).isNull()) / F.count("*")).alias(f"{f}__missing"),
            F.min(f).cast("double").alias(f"{f}__min"),
            F.max(f).cast("double").alias(f"{f}__max"),
            F.avg(f).alias(f"{f}__mean"),
            F.stddev_samp(f).alias(f"{f}__std"),
        ]
    wide = df.groupBy(*by).agg(*stats) if by else df.agg(*stats)
    names = ("missing", "min", "max", "mean", "std")
    packed = F.array(
        *(
            F.struct(F.lit(f).alias("feature"), *(F.col(f"{f}__{n}").alias(n) for n in names))
            for f in features
        )
    )
    return wide.select(*by, F.explode(packed).alias("s")).select(*by, "s.*")


def provenance_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each key column, long."""
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.column").alias("column"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("rows"))
    )


def class_histogram(df: DataFrame, assigned: Column, keys: Sequence[str]) -> DataFrame:
    """Rows per class with the empty classes kept; missing values are left out."""
    counts = (
        df.select(assigned.cast("int").alias("class"))
        .where(F.col("class") >= 0)
        .groupBy("class")
        .agg(F.count("*").alias("n"))
    )
    rows = F.array(
        *(F.struct(F.lit(i).alias("class"), F.lit(k).alias("class_key")) for i, k in enumerate(keys))
    )
    spine = df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return spine.join(counts, "class", "left").fillna(0, ["n"])


def percentile_summary(
    df: DataFrame, group: str, value: str, thresholds: Sequence[float] = (0.9, 0.99)
) -> DataFrame:
    """Count, median, mean and shares at or above each threshold, per group and overall.

    The overall row has a NULL group. Medians come from the sliced percentiles, so neither the
    whole table nor a large group sits in one task.
    """
    shares = [
        F.avg((F.col(value) >= q).cast("double")).alias(f"share_{round(q * 100)}")
        for q in thresholds
    ]
    plain = df.rollup(group).agg(
        F.count("*").alias("events"), F.avg(value).alias("mean_percentile"), *shares
    )
    medians = exact_percentiles(df, [group], value, [0.5]).unionByName(
        exact_percentiles(df, [], value, [0.5]).withColumn(group, F.lit(None).cast("string"))
    )
    medians = medians.select(F.col(group).alias("_g"), F.col("value").alias("median_percentile"))
    return plain.join(medians, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def variance_share(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Variance of the key's means over the total variance, both of the population.

    From sums and squares per key, so it merges over any split of the rows; keys carry equal
    weight, as every cell is scored on the same days.
    """
    v = value
    per_key = df.groupBy(key).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")
    )
    totals = per_key.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.var_pop(F.col("s") / F.col("n")).alias("between"),
    )
    mean = F.col("s") / F.col("n")
    total = F.col("q") / F.col("n") - mean * mean
    return totals.select(
        F.when(total > 0, F.col("between") / total).otherwise(F.lit(0.0)).alias("share")
    )


def crosstab(df: DataFrame, row: str, column: str, normalize: str | None = None) -> DataFrame:
    """Counts of every pair that occurs, with the share along the row or the column, long."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    if normalize is None:
        return counts
    along = row if normalize == "row" else column
    # one row per pair of labels by now
    total = F.sum("n").over(Window.partitionBy(along))
    return counts.withColumn("share", F.col("n") / total)


def yearly_counts(
    df: DataFrame, period: str, label: str, years: Mapping[str, int], known: Sequence[str]
) -> DataFrame:
    """Events per year of each period in every size class, and over all of them."""
    span = F.create_map(*(F.lit(x) for pair in years.items() for x in pair))
    counted = df.groupBy(period).agg(
        *(F.count_if(F.col(label) == k).alias(k) for k in known), F.count("*").alias("all")
    )
    per_year = F.element_at(span, F.col(period))
    return counted.select(period, *((F.col(k) / per_year).alias(k) for k in (*known, "all")))


def label_shares(df: DataFrame, period: str, value: str, positive: str) -> DataFrame:
    """Share of each value among positives and among negatives, and their ratio, per period."""
    counts = df.groupBy(period, value).agg(
        F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n")
    )
    over = Window.partitionBy(period)
    p = F.coalesce(F.try_divide(F.col("_p"), F.sum("_p").over(over)), F.lit(0.0))
    n = F.coalesce(F.try_divide(F.col("_n"), F.sum("_n").over(over)), F.lit(0.0))
    shares = counts.select(period, value, p.alias("positives"), n.alias("negatives"))
    return shares.withColumn(
        "ratio", F.when(F.col("negatives") > 0, F.col("positives") / F.col("negatives"))
    )


def group_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, levels: Mapping[str, float]
) -> DataFrame:
    """Named percentiles per group as columns, off the sliced ordering."""
    names = list(levels)
    steps = exact_percentiles(df, groups, value, [levels[n] for n in names])
    return steps.groupBy(*groups).agg(
        *(F.max(F.when(F.col("rung") == i, F.col("value"))).alias(n) for i, n in enumerate(names))
    )


def agreement(df: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    """Two sources of the same value: means, bias, absolute error, relative bias, correlation."""
    gap = F.col(b) - F.col(a)
    stats = [
        F.count("*").alias("n"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.avg(gap).alias("bias"),
        F.avg(F.abs(gap)).alias("mae"),
        F.try_divide(F.avg(gap), F.avg(a)).alias("relative_bias"),
        F.try_divide(F.sum(b), F.sum(a)).alias("sum_ratio"),
        F.when(
            (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)
        ).alias("pearson"),
    ]
    return df.groupBy(*groups).agg(*stats) if groups else df.agg(*stats)


def spearman(df: DataFrame, a: str, b: str, out: str = "spearman") -> DataFrame:
    """Correlation of the average-tie ranks; monotone in the ranks, so shares serve as well."""
    ranked = percentile_rank(percentile_rank(df, (), a, "_ra"), (), b, "_rb")
    return ranked.agg(
        F.when(
            (F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rb") > 0), F.corr("_ra", "_rb")
        ).alias(out)
    )


def band_agreement(df: DataFrame, band: str, a: Column, b: Column) -> DataFrame:
    """Confusion shares of two yes/no readings per band, and overall under a NULL band."""
    share = lambda c: F.avg(c.cast("double"))
    return df.rollup(band).agg(
        F.count("*").alias("rows"),
        share(a & b).alias("both"),
        share(a & ~b).alias("only_a"),
        share(~a & b).alias("only_b"),
        share(a == b).alias("agree"),
    )


def source_coverage(
    df: DataFrame, groups: Sequence[str], ts: Column, day: Column, value: str
) -> DataFrame:
    """Distinct hours, missing percent, maximum, and the mean of the daily maxima."""
    daily = df.groupBy(*groups, day.alias("_day"), ts.alias("_ts")).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col(value).isNull()).alias("_missing"),
        F.max(value).alias("_top"),
    )
    days = daily.groupBy(*groups, "_day").agg(
        F.count("*").alias("_hours"),
        F.sum("_n").alias("_n"),
        F.sum("_missing").alias("_missing"),
        F.max("_top").alias("_top"),
    )
    return days.groupBy(*groups).agg(
        F.sum("_hours").alias("hours"),
        (F.sum("_missing") * 100.0 / F.sum("_n")).alias("missing_percent"),
        F.max("_top").alias("maximum"),
        F.avg("_top").alias("mean_daily_maximum"),
    )


def corridor_expectation(
    cells: DataFrame, events: DataFrame, corridor: Column, mass: str, recent: Column
) -> DataFrame:
    """Recorded events in a corridor against its share of the expected mass, with Poisson p."""
    parts = cells.agg(
        F.sum(F.when(corridor, F.col(mass)).otherwise(0.0)).alias("_in"),
        F.sum(mass).alias("_all"),
        F.avg(corridor.cast("double")).alias("_cells"),
    )
    placed = events.join(cells.select("cell_id", corridor.alias("_inside")), "cell_id")
    seen = placed.agg(
        F.count_if(F.col("_inside") & recent).alias("observed"),
        F.count_if(recent).alias("_recent"),
        F.avg(F.col("_inside").cast("double")).alias("_density"),
    )
    joined = with_scalars(seen, parts)
    expected = F.col("_in") / F.col("_all") * F.col("_recent")
    return joined.select(
        expected.alias("expected"),
        "observed",
        poisson_two_sided(F.col("observed"), expected).alias("p"),
        (F.col("_density") / F.col("_cells")).alias("record_density"),
    )


def stratified_expectation(
    cells: DataFrame, events: DataFrame, corridor: str, stratum: str, period: str
) -> DataFrame:
    """Corridor events per period against the rate outside it at the same height.

    Cells and events are counted per stratum first; the joins are between rows per stratum.
    """
    strata = cells.groupBy(stratum).agg(
        F.count_if(F.col(corridor)).alias("_in"), F.count_if(~F.col(corridor)).alias("_out")
    )
    hits = (
        events.join(cells.select("cell_id", stratum, corridor), "cell_id")
        .groupBy(period, stratum)
        .agg(
            F.count_if(F.col(corridor)).alias("_hit_in"),
            F.count_if(~F.col(corridor)).alias("_hit_out"),
        )
    )
    rate = F.coalesce(F.try_divide(F.col("_hit_out"), F.col("_out")), F.lit(0.0))
    return (
        hits.join(strata, stratum)
        .groupBy(period)
        .agg(
            F.sum("_hit_in").alias("observed"), F.sum(rate * F.col("_in")).alias("expected")
        )
        .withColumn("ratio", F.try_divide(F.col("observed"), F.col("expected")))
    )


def composition(
    events: DataFrame, period: str, inside: str, flags: Mapping[str, Column]
) -> DataFrame:
    """Shares of each flag among the events inside, beside all events, per period."""
    n_in = F.count_if(F.col(inside))
    out = [n_in.alias("n")]
    for name, flag in flags.items():
        out.append(F.try_divide(F.count_if(F.col(inside) & flag), n_in).alias(name))
        out.append((F.count_if(flag) / F.count("*")).alias(f"all_{name}"))
    return events.groupBy(period).agg(*out)


def attribute(contributions: DataFrame, registry: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature with its share of the whole.

    `contributions` is long (row, column, feature, value); `registry` has a row per feature.
    """
    per_column = contributions.groupBy("column", "feature").agg(
        F.avg(F.abs("value")).alias("_mean")
    )
    per_feature = per_column.groupBy("feature").agg(F.sum("_mean").alias("mean_abs"))
    described = per_feature.join(registry, "feature", "left").fillna(
        "unknown", ["category", "temporal"]
    )
    total = per_feature.agg(F.sum("mean_abs").alias("_total"))
    return with_scalars(described, total).withColumn(
        "share", F.col("mean_abs") / F.col("_total")
    ).drop("_total")


def attribution_by(per_feature: DataFrame, column: str) -> DataFrame:
    return per_feature.groupBy(column).agg(
        F.sum("mean_abs").alias("mean_abs"),
        F.sum("share").alias("share"),
        F.count("*").alias("features"),
    )


def contribution_contrast(
    contributions: DataFrame, near: DataFrame, flank: DataFrame, registry: DataFrame
) -> DataFrame:
    """Mean category contribution near a road less that on its flanks."""
    summed = (
        contributions.join(registry.select("feature", "category"), "feature", "left")
        .fillna("other", ["category"])
        .groupBy("cell_id", "category")
        .agg(F.sum("value").alias("value"))
    )
    sides = near.select("cell_id", F.lit("near").alias("side")).unionByName(
        flank.select("cell_id", F.lit("flank").alias("side"))
    )
    means = F.avg(F.when(F.col("side") == "near", F.col("value")))
    others = F.avg(F.when(F.col("side") == "flank", F.col("value")))
    return (
        summed.join(sides, "cell_id")
        .groupBy("category")
        .agg(means.alias("near"), others.alias("flank"), (means - others).alias("difference"))
    )


def accumulated_mass(
    scored: DataFrame, cell: str, date: str, start: str, stride: int, mass: Column
) -> DataFrame:
    """Per-cell sum over every stride-th day from the start."""
    offset = F.date_diff(F.col(date), F.lit(start).cast("date"))
    picked = scored.where((offset >= 0) & (offset % stride == 0))
    return picked.groupBy(cell).agg(F.sum(mass).alias("mass"))


@dataclass(frozen=True)
class Rule:
    """A row-level rule: rows where `bad` holds break it."""

    name: str
    bad: Column
    observed: Column
    severity: str = "error"


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every rule in one aggregate: bad rows, the observed value and how serious it is."""
    aggregates = []
    for i, rule in enumerate(rules):
        aggregates.append(F.count_if(rule.bad).alias(f"_bad{i}"))
        aggregates.append(rule.observed.cast("double").alias(f"_seen{i}"))
    counted = df.agg(*aggregates)
    packed = F.array(
        *(
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.col(f"_bad{i}").alias("bad"),
                F.col(f"_seen{i}").alias("observed"),
                F.lit(rule.severity).alias("severity"),
            )
            for i, rule in enumerate(rules)
        )
    )
    return counted.select(F.explode(packed).alias("r")).select("r.*")


def bounds_rules(bounds: Mapping[str, tuple[float, float]]) -> list[Rule]:
    out = []
    for name, (low, high) in bounds.items():
        out.append(Rule(f"{name}_in_bounds", ~F.col(name).between(low, high), F.max(name)))
        out.append(Rule(f"{name}_present", F.col(name).isNull(), F.avg(F.col(name).isNull().cast("int")), "warning"))
    return out


def key_problems(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.count("*").alias("keys"),
    )


def sums_to_one(df: DataFrame, key: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose values do not sum to 1, and the largest deviation."""
    totals = df.groupBy(*key).agg(F.sum(value).alias("_s"))
    off = F.abs(F.col("_s") - 1.0)
    return totals.agg(
        F.count("*").alias("keys"),
        F.count_if(off > tolerance).alias("bad"),
        F.max(off).alias("deviation"),
    )


def day_provenance(
    df: DataFrame, date: str, features: Sequence[str], probability: str, age: str
) -> DataFrame:
    """One record per scored day: rows, NULLs per feature as JSON, probability, vegetation age."""
    nulls = F.map_from_arrays(
        F.array(*(F.lit(f) for f in features)),
        F.array(*(F.count_if(F.col(f).isNull()) for f in features)),
    )
    return df.groupBy(date).agg(
        F.count("*").alias("cells"),
        F.to_json(F.map_filter(nulls, lambda k, v: v > 0)).alias("missing_by_feature"),
        F.avg(probability).alias("mean_probability"),
        F.max(probability).alias("max_probability"),
        F.avg(age).alias("mean_age_days"),
    )
