"""The pipeline: each stage works on what the one before kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import decontamination, mixing, ngram_join, quality
from glyphmill.llm.scratch import cut, new_path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    labels, benchmark = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), "test-stage")
        kept[name] = docs
        if name == "quality":
            scored = quality.score_documents(before, labels).where("score >= 0.3")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in scored.collect())
        if name == "near_duplicates":
            again = ngram_join.near_duplicates(docs)
            assert again.where("doc_id <> component").count() == 0
            assert docs.count() == ngram_join.near_duplicates(before).select("component").distinct().count()
        if name == "decontamination":
            assert decontamination.find_contamination(docs, benchmark).where(F.size("spans") > 0).count() == 0
        if name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mixing_plan(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == taken
        assert name == "token_ids" or docs.columns == columns
    out = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_documents(spark, sf):
    """Null and empty texts, null ids and sources, a very long text, repeated rows, and columns that clash; then no documents, labels or benchmark at all."""
    texts = ["some words of a plain text that is long enough to be kept, and it ends here.", None, "", "  \n", "one", "word " * 40_000, "another text, which has other words in it and is not like the first one at all."]
    rows = [(i if i != 3 else None, t, "en", None if i % 2 else "s", "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, lang string, source string, id string, score int, component int")
    path = new_path(spark, "odd")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (6, 1, None), (4, 0, None), (None, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "another text, which has other words in it and is not like"), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, path), "odd-stage")
        if name == "near_duplicates":
            assert docs.where("doc_id = 0").count() in (0, 2)  # rows of one id are one document
        if name == "decontamination":
            assert docs.where("doc_id = 6").count() == 0
        if name != "token_ids":
            assert docs.columns == before.columns
    assert docs.count() == before.count() and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    nothing = new_path(spark, "none")
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{nothing}/{table}.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
