"""The corpus pipeline, stage by stage."""

import pytest


def test_stages_take_effect(spark, sf_dir):
    import corpus_pipeline
    from terralex.llm import decontamination, simhash, toxicity
    from terralex.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.op4_toxicity(spark, sf_dir).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {i for i, p in scores.items() if not p}
        if name == "simhash":
            groups = {r["component_id"] for r in simhash.near_groups(before).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(groups)
        if name == "decontamination":
            leaks = {r["doc_id"] for r in decontamination.find_leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - leaks
        if name == "mixing":
            mixed, base = docs.groupBy("doc_id").count().collect(), {r["doc_id"] for r in before.collect()}
            assert all(r["count"] <= 2 and r["doc_id"] in base for r in mixed)
    assert kept["sharding"].count() == kept["mixing"].count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def test_empty_documents(spark, tmp_path, sf_dir):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    pytest.importorskip("__spark_entry__")
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
