"""Design matrices and Spark ML training, validation and scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.operators.evaluation import group_folds, positive_weight, scores
from gridrisk.operators.joins import with_scalars
from gridrisk.operators.ranking import union_all
from gridrisk.session import cut_lineage

#: Bins of a feature that boosted trees learn from, as many as Spark's trees use by themselves.
BINS = 32


def adapt(
    df: DataFrame, mapping: Mapping[str, Column], order: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Another schema's columns as the common feature vector, in its declared order."""
    return df.select(*keep, *(mapping[name].alias(name) for name in order))


def one_hot(column: str, known: Sequence[str]) -> list[Column]:
    """An indicator per known level, so a one-season day has all of them."""
    return [
        F.when(F.col(column) == level, F.lit(1.0))
        .otherwise(F.lit(0.0))
        .cast("float")
        .alias(f"{column}_{level}")
        for level in known
    ]


def design_matrix(
    df: DataFrame,
    keys: Sequence[str],
    numeric: Sequence[str],
    categories: Mapping[str, Sequence[str]],
    label: Column,
    year: Column,
) -> DataFrame:
    """Features as float32, categories one-hot, the label and the year beside them."""
    hot = [c for name, known in categories.items() for c in one_hot(name, known)]
    return df.select(
        *keys,
        *(F.col(c).cast("float").alias(c) for c in numeric),
        *hot,
        F.coalesce(label, F.lit(False)).cast("tinyint").alias("label"),
        year.cast("int").alias("year"),
    )


@dataclass(frozen=True)
class Spec:
    """What a model is fitted on: columns, label and the learner with its settings."""

    numeric: tuple[str, ...]
    label: str = "label"
    kind: str = "boosted_trees"
    params: Mapping[str, float] = field(default_factory=dict)
    weight: str | None = None


def _boosted_trees(params: Mapping, weight: str | None):
    from pyspark.ml.classification import GBTClassifier

    watched = {}
    if params.get("early_stop"):
        watched = {
            "validationIndicatorCol": "_held",
            "validationTol": float(params.get("tolerance", 0.001)),
        }
    return GBTClassifier(
        featuresCol="features",
        labelCol="_label",
        weightCol="_weight",
        maxIter=int(params.get("rounds", 20)),
        maxDepth=int(params.get("depth", 4)),
        stepSize=float(params.get("step", 0.1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        seed=int(params.get("seed", 7)),
        cacheNodeIds=True,
        **watched,
    )


def _random_forest(params: Mapping, weight: str | None):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(
        featuresCol="features",
        labelCol="_label",
        weightCol="_weight",
        numTrees=int(params.get("trees", 20)),
        maxDepth=int(params.get("depth", 5)),
        seed=int(params.get("seed", 7)),
    )


def _logistic(params: Mapping, weight: str | None):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(
        featuresCol="scaled",
        labelCol="_label",
        weightCol="_weight",
        maxIter=int(params.get("rounds", 50)),
        regParam=float(params.get("penalty", 0.0)),
    )


# learners by name; a new one is a function in this table
LEARNERS: dict[str, Callable] = {
    "boosted_trees": _boosted_trees,
    "random_forest": _random_forest,
    "logistic": _logistic,
}


def prepared(df: DataFrame, spec: Spec, balance: float | None = None) -> DataFrame:
    """Columns the learners read: float features, missing flags, label and row weight.

    Spark's trees have no branch for a missing value, so the median stands in and a flag says so.
    """
    own = F.col(spec.weight) if spec.weight else F.lit(1.0)
    lift = F.lit(float(balance)) if balance is not None else F.lit(1.0)
    return df.withColumns(
        {
            **{f"_f_{c}": F.col(c).cast("double") for c in spec.numeric},
            **{f"_m_{c}": F.col(c).isNull().cast("double") for c in spec.numeric},
            "_label": F.col(spec.label).cast("double"),
            "_weight": F.when(F.col(spec.label) == 1, own * lift).otherwise(own),
        }
    )


def fit(df: DataFrame, spec: Spec, balanced: bool = True, held: Column | None = None):
    """Impute, assemble and learn; `held` marks the rows early stopping watches.

    Boosted trees that draw no rows learn from quantile bins, and from equal rows together.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import Imputer, QuantileDiscretizer, StandardScaler, VectorAssembler

    balance = None
    if balanced:
        weight = F.col(spec.weight) if spec.weight else None
        balance = positive_weight(df, spec.label, weight).first()[0]
    rows = prepared(df, spec, balance)
    if held is not None:
        rows = rows.withColumn("_held", held)
    inputs = [f"_f_{c}" for c in spec.numeric]
    filled = [f"_i_{c}" for c in spec.numeric]
    flags = [f"_m_{c}" for c in spec.numeric]
    learner = LEARNERS[spec.kind](spec.params, spec.weight)
    impute = Imputer(strategy="median", inputCols=inputs, outputCols=filled)
    if spec.kind == "boosted_trees" and float(spec.params.get("subsample", 1.0)) == 1.0:
        bins = QuantileDiscretizer(numBuckets=BINS, inputCols=filled, outputCols=[f"_b_{c}" for c in spec.numeric], handleInvalid="keep")
        front = Pipeline(stages=[impute, bins]).fit(rows)
        assemble = VectorAssembler(inputCols=_binned(spec), outputCol="features")
        classes = cut_lineage(collapsed(front.transform(rows), spec, *(["_held"] if held is not None else [])), "classes")
        return PipelineModel([*front.stages, assemble, learner.fit(assemble.transform(classes))])
    stages = [impute, VectorAssembler(inputCols=[*filled, *flags], outputCol="features")]
    if spec.kind == "logistic":
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True))
    return Pipeline(stages=[*stages, learner]).fit(rows)


def _binned(spec: Spec) -> list[str]:
    return [*(f"_b_{c}" for c in spec.numeric), *(f"_m_{c}" for c in spec.numeric)]


def collapsed(binned: DataFrame, spec: Spec, *more: str) -> DataFrame:
    """Rows of equal bins, flags and label as one row with their weights added.

    A tree only counts weights by bin and label, so it learns the same from them, and a task caches
    classes instead of rows. Not for learners that draw rows.
    """
    return binned.groupBy(*_binned(spec), "_label", *more).agg(F.sum("_weight").alias("_weight"))


def predict(model, df: DataFrame, spec: Spec, out: str = "raw") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(prepared(df, spec))
    keep = [c for c in df.columns if c != out]
    return scored.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(out))


def fit_holdout(df: DataFrame, spec: Spec, train: Column) -> DataFrame:
    """Fit on the training rows and score the rest; an empty or full split is refused."""
    counts = df.agg(F.count_if(train).alias("a"), F.count_if(~train).alias("b")).first()
    if not counts["a"] or not counts["b"]:
        raise ValueError("the split leaves one side empty")
    return predict(fit(df.where(train), spec), df.where(~train), spec)


def cross_validate(
    df: DataFrame, spec: Spec, fold: str, n_folds: int, train_filter: Column | None = None
) -> DataFrame:
    """Out-of-fold scores of every row; each fit is a distributed job, one per fold."""
    parts = []
    for k in range(n_folds):
        learn = df.where(F.col(fold) != k)
        if train_filter is not None:
            learn = learn.where(train_filter)
        parts.append(predict(fit(learn, spec), df.where(F.col(fold) == k), spec))
    return union_all(parts)


def fold_summary(held_out: DataFrame, label: str, fold: str, raw: str = "raw") -> DataFrame:
    """Scores per fold; the mean over the folds is what trials are ranked on."""
    return scores(held_out, label, raw, [fold])


def stacked_score(
    base_rows: DataFrame, base: Spec, df: DataFrame, columns: Mapping[str, Column], out: str
) -> DataFrame:
    """Score another table with a model of the base table, as one more feature."""
    model = fit(base_rows, base)
    adapted = df.withColumns(
        {**dict(columns), **({} if base.label in df.columns else {base.label: F.lit(0)})}
    )
    return predict(model, adapted, base, out)


def ablation(
    df: DataFrame, spec: Spec, blocks: Mapping[str, Sequence[str]], fold: str, n_folds: int
) -> DataFrame:
    """Scores with every block of columns left out in turn, and the change against all of them."""
    tables = []
    for name, left_out in {"none": (), **blocks}.items():
        kept = tuple(c for c in spec.numeric if c not in set(left_out))
        held_out = cross_validate(df, replace(spec, numeric=kept), fold, n_folds)
        tables.append(scores(held_out, spec.label, "raw").withColumn("left_out", F.lit(name)))
    table = union_all(tables).select("left_out", "auprc", "auroc", "brier")
    full = table.where(F.col("left_out") == "none").agg(
        F.max("auprc").alias("_ap"), F.max("auroc").alias("_auc")
    )
    return with_scalars(table, full).select(
        "left_out",
        "auprc",
        "auroc",
        "brier",
        (F.col("auprc") - F.col("_ap")).alias("auprc_delta"),
        (F.col("auroc") - F.col("_auc")).alias("auroc_delta"),
    )


def run_variants(
    variants: Mapping[str, DataFrame], spec: Spec, fold: str, n_folds: int
) -> DataFrame:
    """The same cross-validation on differently prepared samples, one row per variant."""
    return union_all(
        [
            scores(cross_validate(rows, spec, fold, n_folds), spec.label, "raw").withColumn(
                "variant", F.lit(name)
            )
            for name, rows in variants.items()
        ]
    )


def transfer_matrix(
    df: DataFrame, spec: Spec, period: str, periods: Sequence[str], fold: str, n_folds: int
) -> DataFrame:
    """AP and AUROC of a model of each period on every period; on its own, out of fold."""
    tables = []
    for source in periods:
        own = df.where(F.col(period) == source)
        elsewhere = predict(fit(own, spec), df.where(F.col(period) != source), spec)
        at_home = cross_validate(own, spec, fold, n_folds)
        both = elsewhere.unionByName(at_home)
        tables.append(
            scores(both, spec.label, "raw", [period]).withColumn("trained_on", F.lit(source))
        )
    return union_all(tables).withColumnRenamed(period, "scored_on")


def forward_scan(df: DataFrame, spec: Spec, year: str, starts: Sequence[int], test: int) -> DataFrame:
    """Training windows that start later and later, all scored on the years from `test` on."""
    tables = []
    later = df.where(F.col(year) >= test)
    for start in starts:
        rows = df.where((F.col(year) >= start) & (F.col(year) < test))
        held_out = predict(fit(rows, spec), later, spec)
        tables.append(scores(held_out, spec.label, "raw").withColumn("first_year", F.lit(start)))
    return union_all(tables)


def adversarial(
    df: DataFrame, spec: Spec, after: Column, group: str, n_folds: int, seed: int
) -> tuple[DataFrame, list[tuple[str, float]]]:
    """How well the features tell late rows from early ones, with the features' importances.

    Whole groups (days) stay in one fold.
    """
    labelled = df.withColumn("_after", after.cast("int"))
    folds = group_folds(labelled, group, n_folds, seed)
    # read by every fit again
    rows = cut_lineage(labelled.join(folds, group), "late-and-early")
    task = replace(spec, label="_after")
    held_out = cross_validate(rows, task, "fold", n_folds)
    model = fit(rows, task)
    weights = model.stages[-1].featureImportances.toArray()
    names = [*spec.numeric, *(f"{c}_missing" for c in spec.numeric)]
    ranked = sorted(zip(names, map(float, weights)), key=lambda p: (-p[1], p[0]))
    return scores(held_out, "_after", "raw"), ranked
