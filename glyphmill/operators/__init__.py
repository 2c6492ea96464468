"""Running plans over DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.plans import PLANS, load, spark_text
from glyphmill.sources.corpus import frames, query


def run(name: str, **relations: DataFrame) -> DataFrame:
    """A plan over relations of one's own, given by name."""
    load()
    missing = set(PLANS[name][1]) - relations.keys()
    if missing:
        raise ValueError(f"{name} reads {', '.join(sorted(missing))} too")
    spark = next(iter(relations.values())).sparkSession
    return query(spark, spark_text(name), {r: relations[r] for r in PLANS[name][1]})


def run_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plan over the tables in a folder. Some have a form on arrays of whole pages, with the same rows."""
    from glyphmill.operators import page_sums, pages

    load()
    paged = pages.PAGED | page_sums.PAGED
    if name in paged and pages.alone(docs := frames(spark, sf_dir, ("documents",))["documents"]):
        return paged[name](spark, docs)
    return run(name, **frames(spark, sf_dir, PLANS[name][1]))


def run_matrix(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], path: str, at_once: int = 4) -> DataFrame:
    """Runs queries, some at once, each result to a table of its own under path: (name, rows, seconds, error). One that fails is noted, and the rest go on; what is under path already isn't run again."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def one(name: str, query: Callable[[SparkSession, str], DataFrame]) -> tuple:
        out = hadoop.Path(f"{path}/{name}/_SUCCESS")
        began, error = time.time(), None
        try:
            if not out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):
                query(spark, sf_dir).write.mode("overwrite").parquet(f"{path}/{name}")
            rows = spark.read.parquet(f"{path}/{name}").count()
        except Exception as e:  # noted, not raised
            rows, error = None, str(e)[:500]
        return name, rows, round(time.time() - began, 3), error

    with ThreadPoolExecutor(at_once) as pool:
        notes = list(pool.map(lambda x: one(*x), queries.items()))
    return spark.createDataFrame(notes, "name string, rows bigint, seconds double, error string")


def run_stages(spark: SparkSession, sf_dir: str, stages: dict[str, dict[str, Callable[[SparkSession, str], DataFrame]]], path: str, at_once: int = 4) -> DataFrame:
    """Groups of queries one after another, such as controls before what they are controls of: a group begins once all of the one before have ended without an error."""
    notes = None
    for stage, queries in stages.items():
        own = run_matrix(spark, sf_dir, queries, f"{path}/{stage}", at_once).select(F.lit(stage).alias("stage"), "*")
        notes = own if notes is None else notes.union(own)
        if not own.where("error is not null").isEmpty():
            break
    return notes
