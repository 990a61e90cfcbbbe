"""One registered query for each operator, over whole tables, and its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridrisk.llm import contamination, conversations, histogram_packing, licenses, near_duplicates, packing, privacy, quality, resampling, sentences, sharding, suffixes, tokens
from gridrisk.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(table(spark, sf_dir, "documents"))


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.digest(table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.digest(table(spark, sf_dir, "documents"))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # its contract ends documents with id 0
    return histogram_packing.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end=0)


def op13_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_suffix_dedup, op3_vector_packing, op4_private_terms, op5_adaptive_quality, op6_order_minhash, op7_sentence_spans, op8_token_blocks, op9_feistel_shards, op10_fm_index, op11_auction_repair, op12_histogram_packing, op13_radix_resampling)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CHECKS: dict[str, str] = {
    "op10_fm_index": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS win
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN sizes ON len(w) >= n)),
found AS (SELECT p.doc_id, p.k, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
