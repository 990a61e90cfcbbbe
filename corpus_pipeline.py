"""From raw documents to training sequences: filter, de-duplicate, decontaminate, generalise, pack."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridrisk.llm import contamination, near_duplicates, packing, privacy, quality
from gridrisk.session import cut_lineage, remove_staged, ship_package, staged_paths

#: Staged tables of the stage before, apart for each thread that runs the pipeline.
_left: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose predecessor's result has been written: the tables that one staged are removed."""

    @wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_staged(ship_package(spark), list(_left.get()))
        with staged_paths() as made:
            out = work(spark, docs, sf_dir)
        _left.set(tuple(made))
        return out

    return staged


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a cutoff of their language and source go."""
    return quality.passing(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least doc_id."""
    return near_duplicates.one_of_each(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in a place of a benchmark window are cut out of the texts."""
    return contamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def private_terms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that reveal it, are replaced by the names of their kinds."""
    return privacy.sanitised(docs)


@stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence."""
    return packing.packed_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("privacy", private_terms),
    ("packing", sequence_packing),
]

#: SQL has no quantile sketches, no alignment and no tokenizer. The tests hold the operators against
#: plain Python, and run() against its stages called one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read by the next."""
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = cut_lineage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
