import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline
    from gridrisk.llm import contamination, near_duplicates, privacy, quality
    from gridrisk.session import cut_lineage

    folder = "/root/testdata/sf0.001"
    docs = raw = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "packing":
            assert docs.schema.simpleString() == raw.schema.simpleString()
    kept = {r.doc_id for r in quality.digest(raw).where("kept").collect()}
    assert {r.doc_id for r in seen["quality"].collect()} == kept
    assert near_duplicates.digest(seen["near_dedup"]).where("not kept").count() == 0
    assert contamination.digest(seen["decontamination"], bench).where("contaminated").count() == 0
    assert privacy.digest(seen["privacy"]).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["privacy"].collect()}
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
