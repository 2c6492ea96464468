"""A language's pages cut, in the order of their ids, in chunks that end with the line which fills them.

Where a chunk ends depends on where it began, but each line can say where a chunk that began with it would end. These
pointers follow from running counts of words, by an equality join over buckets of them; following them 1, 2, 4, ... chunks
at a time finds all beginnings in as many joins as the number of chunks has bits. No language is one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.lineage import settled

#: Words that fill a chunk.
CHUNK_WORDS = 250
#: Ids that are counted together.
BLOCK = 4096


def _numbered(lw: DataFrame) -> DataFrame:
    """Lines with words: their place among those of the language (at, from 0) and the words before and up to their end (low, high)."""
    lines = lw.select("lang", "doc_id", "line_no", F.size("words").cast("bigint").alias("n")).where("n > 0")
    pages = lines.groupBy("lang", "doc_id").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("l")).withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    before = Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pages.groupBy("lang", "block").agg(F.sum("w").alias("w"), F.sum("l").alias("l")).select("lang", "block", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"))
    inside = Window.partitionBy("lang", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("w1", F.coalesce(F.sum("w").over(inside), F.lit(0))).withColumn("l1", F.coalesce(F.sum("l").over(inside), F.lit(0)))
    pages = pages.join(blocks, ["lang", "block"]).select("lang", "doc_id", (F.col("w0") + F.col("w1")).alias("w"), (F.col("l0") + F.col("l1")).alias("l"))
    own = Window.partitionBy("lang", "doc_id").orderBy("line_no")
    lines = lines.withColumn("upto", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(own) - 1)
    return lines.join(pages, ["lang", "doc_id"]).select("lang", "doc_id", "line_no", (F.col("l") + F.col("nth")).alias("at"), (F.col("w") + F.col("upto") - F.col("n")).alias("low"), (F.col("w") + F.col("upto")).alias("high"))


def hand_chunks(lw: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """(lang, doc_id, line_no, chunk, nth) for every line of a whole chunk: chunk is the place of its first line, nth the line's place in it.

    lw: lines as arrays of words. A chunk ends with the line that brings it to size words or more, across pages; what is
    left at a language's end is in none. Lines without words are in none.
    """
    lines = settled(_numbered(lw))
    most = lines.agg(F.max("high")).first()[0]
    div = lambda c: F.expr(f"{c} div {size}")
    # a chunk that begins at low is full at the first line whose high is low + size or more
    ends = lines.select("lang", div("high").alias("bucket"), "high", F.col("at").alias("end"))
    here = lines.select("lang", "at", (F.col("low") + size).alias("full")).withColumn("bucket", div("full"))
    # else at the line with which the next bucket begins
    over = lines.select("lang", F.col("at").alias("first"), F.explode(F.expr(f"case when high div {size} > low div {size} then sequence(low div {size} + 1, high div {size}) else array() end")).alias("bucket"))
    near = here.join(ends, ["lang", "bucket"]).where("high >= full").groupBy("lang", "at").agg(F.min("end").alias("end"))
    far = here.join(over.withColumn("bucket", F.col("bucket") - 1), ["lang", "bucket"]).select("lang", "at", F.col("first").alias("end"))
    following = settled(near.union(far).groupBy("lang", "at").agg((F.min("end") + 1).alias("next")))
    jump, begins = following, lines.where("at = 0").select("lang", "at")
    for _ in range(math.ceil(math.log2((most or 0) / size + 2))):
        begins = settled(begins.union(begins.join(jump, ["lang", "at"]).select("lang", F.col("next").alias("at"))))
        jump = settled(jump.withColumnRenamed("next", "mid").join(jump.withColumnRenamed("at", "mid"), ["lang", "mid"]).select("lang", "at", "next"))
    chunks = begins.join(following, ["lang", "at"]).select("lang", F.col("at").alias("chunk"), F.explode(F.expr("sequence(at, next - 1)")).alias("at"))
    return lines.join(chunks, ["lang", "at"]).select("lang", "doc_id", "line_no", "chunk", (F.col("at") - F.col("chunk")).alias("nth"))
