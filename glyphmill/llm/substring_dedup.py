"""Passages repeated across documents, by hashing lines, paragraphs and the sentences of lines.

A unit is normalised to its lower-case words. Equal units are grouped over the whole corpus by a 128-bit digest; the
earliest, by document id and place, is kept. Later copies of lines and paragraphs go by themselves, if they have words
enough. As passages begin and end inside lines, sentences are units too; later copies of these go where they stand in
an unbroken run of repeats that has words enough from one and the same kept document: single short sentences that many
texts share by chance stay, and so do rows of chance repeats. Spans keep their offsets in the original text, and name
the documents that hold the first copy of what they held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.scratch import cut

#: Words that a run of repeated sentences must share with one kept document to be taken out; short sentences count too.
RUN_WORDS = 20
#: Words of a repeated line or paragraph from which on it goes by itself. With 1 all do: then half of all documents lose a
#: short line that many share by chance.
WHOLE_WORDS = 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in "\n.!?"]] = True


def units(texts: pa.Array, whole: int | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Units of all texts: for each text where its units begin, and for each unit two hashes, its words, and its place in words and characters.

    With whole, sentences that are a line of so many words say so; other lines, and paragraphs of several lines, that
    have as many follow with a unit of -1.
    """
    codes, bounds, starts, _ = wc.word_codes(texts, wc.LETTERS_DIGITS, places=True)
    data, off = wc.text_bytes(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def begins(cuts: np.ndarray) -> np.ndarray:
        first = np.unique(np.concatenate([bounds[:-1], np.searchsorted(starts, cuts)]))
        return first[first < len(codes)]

    def hashed(first: np.ndarray) -> dict[str, np.ndarray]:
        words = np.diff(np.append(first, len(codes)))
        place = (np.arange(len(codes)) - np.repeat(first, words)).astype(np.uint64)
        sums = []
        for salt in (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)):
            each = wc.mix(codes ^ wc.mix(place * salt + salt))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
            sums.append(wc.mix(total[first + words] - total[first] + words.astype(np.uint64) * salt).view(np.int64))
        doc = np.searchsorted(bounds, first, "right") - 1
        begin = starts[first] if len(first) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(data))
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        end[: len(doc)][last] = off[doc[last] + 1]
        end = end[: len(doc)]
        return {"h1": sums[0], "h2": sums[1], "words": words, "start": chars[begin] - chars[off[doc]], "end": chars[end] - chars[off[doc]], "doc": doc, "word": first - bounds[doc], "first": first}

    own = hashed(begins(np.flatnonzero(_BREAKS[data])))
    at = np.searchsorted(own["doc"], np.arange(len(bounds)))
    own["unit"] = np.arange(len(own["doc"])) - at[own["doc"]]
    own["whole"] = np.zeros(len(own["doc"]), bool)
    if whole is None:
        return at, own
    breaks = np.flatnonzero(data == 10)
    lines = hashed(begins(breaks))
    # a break is blank if there is only space between it and the one before
    dark = np.concatenate([[0], np.cumsum(wc.NOT_SPACE[data])])
    paragraphs = hashed(begins(breaks[1:][dark[breaks[1:]] == dark[breaks[:-1]]]))
    same = np.searchsorted(own["first"], lines["first"])
    single = own["words"][same] == lines["words"]
    own["whole"][same[single & (lines["words"] >= whole)]] = True
    several = lines["words"][np.searchsorted(lines["first"], paragraphs["first"])] != paragraphs["words"]
    for more, keep in ((lines, ~single), (paragraphs, several)):
        more |= {"unit": np.full(len(more["doc"]), -1), "whole": np.ones(len(more["doc"]), bool)}
        keep = keep & (more["words"] >= whole)
        own = {k: np.concatenate([v, more[k][keep]]) for k, v in own.items()}
    return at, own


_UNITS = "id bigint, copy bigint, unit int, whole boolean, h1 bigint, h2 bigint, words int, word int, start bigint, end bigint"


def _scan(whole: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                _, u = units(part["text"], whole)
                ints = {c: pa.array(u[c].astype(np.int32)) for c in ("unit", "words", "word")}
                docs = pa.array(u["doc"])
                yield pa.RecordBatch.from_arrays([part["id"].take(docs), part["copy"].take(docs), ints["unit"], pa.array(u["whole"]), pa.array(u["h1"]), pa.array(u["h2"]), ints["words"], ints["word"], pa.array(u["start"]), pa.array(u["end"])], ["id", "copy", "unit", "whole", "h1", "h2", "words", "word", "start", "end"])

    return run


def _copies(docs: DataFrame) -> DataFrame:
    """docs with a column copy: the hash of the text where any id has rows of different texts, else 0, which takes no room in shuffles."""
    texts = F.xxhash64("text")
    alone = docs.where("id is not null").groupBy("id").agg(F.min(texts).alias("a"), F.max(texts).alias("b")).where("a <> b").isEmpty()
    return docs.withColumn("copy", F.lit(0).cast("bigint") if alone else texts)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, whole: int | None = None) -> DataFrame:
    """(id, copy, removed) for every document that loses something; ids are integers.

    removed lists spans in order: start and end in characters, words, and kept_in, ids of the documents that keep
    what the span held (its own among them if it repeats itself). Texts without words, null and empty ones have no
    units. Rows of one id and text are one document, all of them lose the same; rows of one id
    with different texts are documents of their own, which copy, a hash of the text, tells apart (0 where no id has
    several texts). Rows with a null id are left alone. Other columns are not read. With whole, lines and paragraphs of so many words that are there before
    go by themselves; kept_in then names where the first copy is.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return _repeated(_copies(own), run_words, whole).withColumnRenamed("id", id_col)


def _repeated(own: DataFrame, run_words: int, whole: int | None) -> DataFrame:
    """repeated_passages() of (id, text, copy)."""
    found = cut(own.mapInArrow(_scan(whole), _UNITS), "units")
    place = F.struct("id", "copy", "word")
    kept = found.groupBy("h1", "h2").agg(F.min(F.when(F.col("unit") >= 0, place)).alias("kept"), F.min(F.when(F.col("whole"), place)).alias("kept_whole"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # a table of its own, so that the join stands right on its shuffles and Spark can split a very common unit
    kept = cut(kept.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "kept", "kept_whole"), "kept-units")
    repeats = found.join(kept, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    # kind 0: a unit that may be part of a run, 1: a line or paragraph that goes by itself
    kinds = [F.when((F.col(c) if c == "whole" else F.col("unit") >= 0) & (place != F.col(k)), F.struct(F.lit(n).alias("kind"), F.col(f"{k}.id").alias("kept_id"))) for n, c, k in ((0, "unit", "kept"), (1, "whole", "kept_whole"))]
    repeats = repeats.select("id", "copy", "unit", "words", "word", "start", "end", F.explode(F.array_compact(F.array(*kinds))).alias("as")).select("id", "copy", "unit", "words", "word", "start", "end", "as.kind", "as.kept_id")
    ordered = Window.partitionBy("id", "copy").orderBy("kind", "unit")
    runs = repeats.withColumn("run", F.when(F.col("kind") == 0, F.col("unit") - F.dense_rank().over(ordered)).otherwise(F.col("word")))
    shared = runs.groupBy("id", "copy", "kind", "run", "kept_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("low"), F.max(F.col("word") + F.col("words")).alias("high"), F.sum("words").alias("shared"))
    spans = shared.groupBy("id", "copy", "kind", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("shared").alias("shared"), F.collect_list("kept_id").alias("kept_in"))
    spans = spans.where((F.col("kind") == 1) | (F.col("shared") >= run_words))
    before = F.max("high").over(Window.partitionBy("id", "copy").orderBy("low", "high", "kind").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("low") <= before, 0).otherwise(1))
    spans = spans.withColumn("span", F.sum("new").over(Window.partitionBy("id", "copy").orderBy("low", "high", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "copy", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("high") - F.min("low")).cast("bigint").alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"))
    return spans.groupBy("id", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "end", "words", "kept_in"))).alias("removed"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, all_rows: bool = True, whole: int | None = None) -> DataFrame:
    """(id, text, removed): texts without what repeated_passages() finds; of all rows, or those that lose something."""
    own = _copies(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    found = _repeated(own.where("id is not null").withColumn("id", F.col("id").cast("bigint")), run_words, whole).toDF("_id", "_copy", "removed")
    joined = own.join(found, (F.col("id") == F.col("_id")) & (F.col("copy") == F.col("_copy")), "left" if all_rows else "inner").select("id", "text", "removed")
    id_type = own.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, text string, removed array<struct<start: bigint, end: bigint, words: bigint, kept_in: array<bigint>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, spans in enumerate(batch["removed"].to_pylist()):
                if spans and texts[i] is not None:
                    at, parts = 0, []
                    for s in spans:
                        parts.append(texts[i][at : s["start"]])
                        at = max(at, s["end"])
                    texts[i] = "".join([*parts, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string()), batch["removed"]], ["id", "text", "removed"])

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    out = remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), all_rows=False, whole=WHOLE_WORDS)
    kept_in = F.array_sort(F.array_distinct(F.flatten(F.transform("removed", lambda s: s["kept_in"]))))
    words = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    return out.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), words.alias("removed_words"), kept_in.alias("kept_in"), "removed", "text")
