"""A corpus from raw documents to token ids, in five stages; each works on all that the one before kept.

1. quality: documents that the rule ensemble scores below its threshold go.
2. near_duplicates: of each group of linked documents the one with the smallest id stays.
3. decontamination: documents that share a window of words with the benchmark go.
4. mixing: the sources are mixed to their target weights; documents are repeated or left out.
5. token_ids: every document's ids are written to a content-addressed store and read back.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, mixing, ngram_join, quality, token_store
from glyphmill.llm.scratch import cut, new_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(docs, path, token_store.tokenizer_file())
    return token_store.verify_store(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("token_ids", _token_ids),
]
#: SQL has no form of the fitted classifier, the mix or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
