"""Ranked lexical search: the product of an item-by-term and a term-by-document matrix, in blocks, with the best of each row kept.

The documents' matrix is made in one scan and written once: a row per document with the codes and counts of those of its
terms that any item may hold. Which those are is told by a map of BITS bits, whatever the number of items. Document
frequencies and lengths then come from that table. Items are multiplied in blocks of bounded size with blocks of
documents where these lie; nothing of the documents is shuffled but their best. Within a block numpy goes along an item's
terms and merges their rows of impacts (Gustavson), in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.scratch import cut, drop

TOP = 10
#: Bits of the map of terms that items hold, a power of two.
BITS = 1 << 22
#: Terms of all items of a block at most (28 bytes each), but for one item that alone has more.
BLOCK_TERMS = 1 << 20
#: Documents, and terms of theirs, multiplied at once; a document of more terms is a block of its own.
DOCS, POSTINGS = 1 << 14, 1 << 20


def _bags(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each text in ascending order, their counts, and where each text's begin."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return codes[first], np.diff(np.append(first, len(codes))), np.searchsorted(doc[first], np.arange(len(bounds)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            codes, n, edges = _bags(*wc.word_codes(part["text"], wc.LETTERS_DIGITS))
            rows = np.repeat(np.arange(part.num_rows), np.diff(edges))
            yield pa.RecordBatch.from_arrays([part["item"].take(pa.array(rows)), part["row"].take(pa.array(rows)), pa.array(codes.view(np.int64)), pa.array(n)], ["item", "row", "code", "times"])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, bounds = wc.word_codes(part["text"], wc.LETTERS_DIGITS)
                length = np.diff(bounds)
                place = (codes & np.uint64(BITS - 1)).astype(np.int64)
                keep = (wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                kept = np.concatenate([[0], np.cumsum(keep)])
                codes, n, edges = _bags(codes[keep], kept[bounds])
                rows = np.flatnonzero(length)
                edges = np.append(edges[:-1][rows], edges[-1]).astype(np.int32)  # texts without words have no codes
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(rows)), pa.array(length[rows]), pa.ListArray.from_arrays(edges, pa.array(codes.view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(n))],
                    ["id", "length", "codes", "counts"],
                )
            wc.release()

    return run


class _Items:
    """Items of a block: codes of all their terms in order, and for each item which terms with what weight."""

    def __init__(self, table: pa.Table):
        row, code, weight = (table[c].to_numpy() for c in ("row", "code", "weight"))
        self.codes, term = np.unique(code, return_inverse=True)
        order = np.lexsort((term, row))
        self.rows, first = np.unique(row[order], return_index=True)
        self.edges = np.append(first, len(row))
        self.terms, self.weights = term[order], weight[order]


class _Best:
    """The best of each item so far: scores, then ids, null ones last."""

    def __init__(self, items: int, top: int):
        self.top, self.held = top, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, z = (np.concatenate(x) for x in zip(self.held[item], (score, ids, null)))
        if len(s) > self.top:
            least = np.partition(s, len(s) - self.top)[len(s) - self.top]
            near = np.flatnonzero(s >= least)
            near = near[np.lexsort((i[near], z[near], -s[near]))[: self.top]]
            s, i, z = s[near], i[near], z[near]
        self.held[item] = (s, i, z)


def _multiply(items: _Items, best: _Best, ids: np.ndarray, null: np.ndarray, norm: np.ndarray, edges: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
    """One block of documents: impacts in rows by term, which the rows of items merge."""
    at = np.minimum(np.searchsorted(items.codes, codes), len(items.codes) - 1)
    known = items.codes[at] == codes
    doc = np.repeat(np.arange(len(ids)), np.diff(edges))[known]
    at, counts = at[known], counts[known]
    impact = (1_000_000_000 * counts) // (1000 * counts + 8 * norm[doc])
    order = np.argsort(at, kind="stable")
    doc, impact = doc[order], impact[order]
    row = np.searchsorted(at[order], np.arange(len(items.codes) + 1))
    total = np.zeros(len(ids), np.int64)
    for k in range(len(items.rows)):
        terms = items.terms[items.edges[k] : items.edges[k + 1]]
        for t, w in zip(terms.tolist(), items.weights[items.edges[k] : items.edges[k + 1]].tolist()):
            a, b = row[t], row[t + 1]
            if w and a < b:
                total[doc[a:b]] += w * impact[a:b]  # a document stands once in a term's row
        hit = np.flatnonzero(total)
        if len(hit):
            best.add(k, total[hit], ids[hit], null[hit])
            total[hit] = 0


def _product(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = _Best(len(items.rows), top)

        def flush(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            codes, counts = t["codes"].combine_chunks(), t["counts"].combine_chunks()
            edges = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            _multiply(items, best, t["id"].fill_null(0).to_numpy(), t["id"].is_null().to_numpy(), t["norm"].to_numpy(), edges, codes.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False))

        held, docs, postings = [], 0, 0
        for batch in batches:
            n = batch["codes"].value_lengths().to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(n[at:]), POSTINGS - postings, "right")
                end = min(batch.num_rows, at + min(int(room), DOCS - docs))
                if end == at and not held:
                    end = at + 1
                if end > at:
                    held.append(batch.slice(at, end - at))
                    docs, postings = docs + end - at, postings + int(n[at:end].sum())
                if end < batch.num_rows:
                    flush(held)
                    held, docs, postings = [], 0, 0
                at = end
        if held:
            flush(held)
        sizes = [len(s) for s, _, _ in best.held]
        if sum(sizes):
            s, i, z = (np.concatenate(x) for x in zip(*best.held))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items.rows, sizes)), pa.array(i, mask=z), pa.array(s)], ["row", "id", "score"])
        wc.release()

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, multiplicity: bool = True) -> DataFrame:
    """(item, rank, id, score): the documents of the highest scores above 0 for each item, at most top of them, ranks from 1.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its impact in a document (10^9 tf) div (1000 tf + 8m) with
    m = 10 + (90 n N) div L; a score sums weight times impact over the item's terms, each as often as the item holds it,
    or once without multiplicity. Ids are integers; equal scores go by them, null ones last. N counts documents with a term.
    Null and empty texts, and texts without terms, are in no count and never found; items of that kind, and ones that share no
    term with a document, have no rows. Each row of either table counts for itself, also where ids repeat or are null.
    Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    own = cut(own.withColumn("row", F.monotonically_increasing_id()), "search-items")
    item_type = own.schema["item"].dataType.simpleString()
    terms = cut(own.mapInArrow(_item_terms, f"item {item_type}, row bigint, code bigint, times bigint"), "item-terms")
    # bounded by BITS, whatever the items
    bits = terms.select(F.pmod("code", F.lit(BITS)).alias("at")).groupBy(F.expr("at div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 as int)))").alias("bits")).toArrow()
    wanted = np.zeros(BITS // 8, np.uint8)
    wanted[bits["byte"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint8)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    matrix = cut(texts.mapInArrow(_scan(spark.sparkContext.broadcast(wanted)), "id bigint, length bigint, codes array<bigint>, counts array<bigint>"), "document-terms")

    n, words = matrix.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    # of the items' own terms alone: the map lets others pass
    vocabulary = terms.select("code").distinct()
    df = matrix.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "code", "left_semi")
    weight = F.floor(1000 * F.log((F.lit(2.0) * F.lit(n) + 2) / (2 * F.col("df") + 1)))
    weight = weight * F.col("times") if multiplicity else weight
    weighed = cut(terms.join(df, "code").select("item", "row", "code", weight.cast("bigint").alias("weight")), "weighed-terms")
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    ninety_n = F.lit(90 * n).cast("decimal(26,0)")  # products of decimals, as a long may not hold them
    norm = 10 + F.expr("p div l") if words else F.lit(10)
    ready = matrix.select("id", "codes", "counts", (F.col("length").cast("decimal(12,0)") * ninety_n).alias("p"), F.lit(words).cast("decimal(20,0)").alias("l")).select("id", norm.cast("bigint").alias("norm"), "codes", "counts")
    schema = "row bigint, id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        block = weighed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("row", "code", "weight").toArrow()
        if block.num_rows:
            best = ready.mapInArrow(_product(spark.sparkContext.broadcast(_Items(block)), top), schema)
            found = best if blocks == 1 else found.union(cut(best, "found"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= top)
    names = own.select("row", "item")
    out = cut(ranked.join(names, "row").select("item", "rank", F.col("id"), "score"), "ranked")
    drop(matrix, terms, weighed)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), multiplicity=False)


OP13_SQL = r"""
with words as (
  select doc_id, row_number() over () d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w
  from documents where text is not null),
docs as (select * from words where len(w) > 0),
totals as (select count(*)::bigint n, sum(len(w))::bigint l from docs),
terms as (
  select item_id, i, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) term
  from (select *, row_number() over () i from benchmark where text is not null)),
counts as (select d, term, count(*)::bigint tf from (select d, unnest(w) term from docs) group by d, term),
weights as (select term, floor(1000 * ln((2.0::double * n + 2) / (2 * df + 1)))::bigint weight from (select term, count(*)::bigint df from counts group by term), totals),
scores as (
  select item_id, i, doc_id, d, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(docs.w) * n) // l))))::bigint score
  from terms join weights using (term) join counts using (term) join docs using (d), totals group by all)
select item_id, (row_number() over (partition by i order by score desc, doc_id))::int rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""
