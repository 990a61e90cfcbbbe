"""Search over a learner's settings with a settled number of rounds, and the fit that follows it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from statistics import median

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.operators.evaluation import log_loss, scores
from gridrisk.operators.models import Spec, collapsed, fit, predict, prepared
from gridrisk.operators.ranking import union_all
from gridrisk.session import cut_lineage

TRIALS, FOLDS, ROUNDS, PATIENCE = 100, 5, 2000, 50

#: What trials are ranked by, larger being better: a column of the trial table.
OBJECTIVES = ("pooled_auprc", "fold_lift", "fold_neg_log_loss", "fold_auroc")


@dataclass(frozen=True)
class Range:
    """A setting's range; drawn on a log scale or as a whole number if so marked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float:
        if self.whole:
            return min(self.high, math.floor(self.low + u * (self.high - self.low + 1)))
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        return self.low + u * (self.high - self.low)


def draw_trials(space: Mapping[str, Range], n: int = TRIALS, seed: int = 42) -> list[dict[str, float]]:
    """n settings, each from the hash of seed, setting and trial, so a trial never depends on others."""

    def uniform(name: str, trial: int) -> float:
        return int(hashlib.md5(f"{seed}|{name}|{trial}".encode()).hexdigest()[:15], 16) / float(1 << 60)

    return [{name: span.at(uniform(name, trial)) for name, span in space.items()} for trial in range(n)]


def on_the_boundary(params: Mapping[str, float], space: Mapping[str, Range], margin: float = 0.02) -> list[str]:
    """Settings within a margin of the range from one of its ends."""
    near = lambda value, span: min(value - span.low, span.high - value) <= margin * (span.high - span.low)
    return sorted(name for name, span in space.items() if name in params and near(params[name], span))


def settled_rounds(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Rounds up to the best loss before `patience` rounds in a row bring no better one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def staged_losses(model: PipelineModel, held: DataFrame, spec: Spec) -> list[float]:
    """The loss of the held-out rows after every round, in one pass over them."""
    ready = PipelineModel(model.stages[:-1]).transform(prepared(held, spec))
    if isinstance(model.stages[1], Bucketizer):
        # every round reads them again
        ready = model.stages[-2].transform(cut_lineage(collapsed(ready, spec), "held-classes"))
    return list(model.stages[-1].evaluateEachIteration(ready))


def settled_model(learn: DataFrame, held: DataFrame, spec: Spec, rounds: int = ROUNDS, patience: int = PATIENCE) -> tuple[PipelineModel, int]:
    """The model stopped where the held-out loss settles within `rounds`, and its number of rounds.

    Runs double until they show `patience` rounds without a better loss. The first rounds of a longer
    run with the same seed are those of a shorter one, so all rounds would settle at the same place.
    Held-out rows count as they are, whatever the rows learnt from weigh.
    """
    tried = min(rounds, 2 * patience)
    while True:
        model = fit(learn, replace(spec, params={**spec.params, "rounds": tried}))
        settled = settled_rounds(staged_losses(model, held, replace(spec, weight=None)), patience)
        if settled + patience <= tried or tried == rounds:
            break
        tried = min(rounds, 2 * tried)
    if settled < tried:
        model = fit(learn, replace(spec, params={**spec.params, "rounds": settled}))
    return model, settled


def tuned_folds(df: DataFrame, spec: Spec, fold: str, n_folds: int, rounds: int, patience: int) -> tuple[DataFrame, list[int]]:
    """Out-of-fold scores, each fold's model stopped where its own held-out loss settles."""
    parts, settled = [], []
    for k in range(n_folds):
        learn, held = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        model = fit(learn, replace(spec, params={**spec.params, "rounds": rounds}))
        settled.append(settled_rounds(staged_losses(model, held, spec), patience))
        if settled[-1] < rounds:
            # the first rounds of a longer run with the same seed
            model = fit(learn, replace(spec, params={**spec.params, "rounds": settled[-1]}))
        parts.append(predict(model, held, spec))
    return union_all(parts), settled


def trial_table(df: DataFrame, spec: Spec, trials: Sequence[Mapping[str, float]], fold: str, n_folds: int = FOLDS, rounds: int = ROUNDS, patience: int = PATIENCE) -> DataFrame:
    """A row a trial: its settings, settled rounds and all objectives, so that it can be ranked by any.

    The settled count is the median over the folds. Trials run one after the other, each fit being
    a job over the whole table.
    """
    tables = []
    for number, params in enumerate(trials):
        own = replace(spec, params={**spec.params, **params})
        held_out, settled = tuned_folds(df, own, fold, n_folds, rounds, patience)
        held_out = cut_lineage(held_out, "trial-scores")
        by_fold = scores(held_out, spec.label, "raw", [fold]).join(log_loss(held_out, spec.label, "raw", [fold]), fold)
        means = by_fold.agg(F.avg("lift").alias("fold_lift"), (-F.avg("log_loss")).alias("fold_neg_log_loss"), F.avg("auroc").alias("fold_auroc"))
        pooled = scores(held_out, spec.label, "raw").select(F.col("auprc").alias("pooled_auprc"), F.lit(number).alias("trial"))
        row = pooled.join(means.withColumn("trial", F.lit(number)), "trial")
        tables.append(row.withColumns({"rounds": F.lit(int(median(settled))), **{n: F.lit(float(v)) for n, v in params.items()}}))
    return cut_lineage(union_all(tables), "trials")


def best_trial(trials: DataFrame, objective: str = OBJECTIVES[0]) -> dict:
    """The best trial by an objective, the first one on a tie."""
    if objective not in OBJECTIVES:
        raise ValueError(f"not an objective: {objective}")
    row = trials.orderBy(F.desc(objective), F.asc("trial")).first()
    return row.asDict() if row else {}


def final_fit(df: DataFrame, spec: Spec, best: Mapping[str, float], space: Mapping[str, Range]) -> PipelineModel:
    """The model of all rows with the best settings and the settled rounds; nothing stops it early."""
    params = {name: best[name] for name in space}
    return fit(df, replace(spec, params={**spec.params, **params, "rounds": best["rounds"], "early_stop": 0}))
