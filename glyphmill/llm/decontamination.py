"""Benchmark decontamination by winnowed fingerprints.

Both sides keep the smallest hash of k words in every run of w of them; two texts that share k + w - 1 words keep the
same one there. Document fingerprints that occur among those of the benchmark are extended to every window of the
guaranteed length around them, and the windows are compared. With k + w - 1 equal to the window, no shared window
is missed. Items shorter than a window form classes of their own, with their length as the guaranteed length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.scratch import small_batches

WINDOW = 10
#: Benchmark text that one broadcast block may hold; a larger benchmark is compared block by block.
BLOCK_BYTES = 16 << 20
_MAX = np.uint64(2**64 - 1)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Where a hash is the smallest of some run of w; of equal smallest ones all are kept."""
    w = min(w, len(hashes))
    if w <= 1:
        return np.ones(len(hashes), bool)
    low = _sliding(hashes, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return _sliding(np.concatenate([edge, low, edge]), w, np.maximum) == hashes


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every run of w, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def _shape(length: int) -> tuple[int, int]:
    """Words in a gram and grams in a window that guarantee shared runs of this length."""
    k = (length + 1) // 2
    return k, length - k + 1


def _class_grams(codes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where fingerprints stand, the gram hashes, and the hashes of whole windows (greatest value: there is none)."""
    k, w = _shape(length)
    ends = wc.gram_ends(bounds)
    small = wc.grams(codes, k)
    small[np.arange(len(small)) + k > ends[: len(small)]] = _MAX
    windows = wc.grams(codes, length) if len(codes) >= length else np.zeros(0, np.uint64)
    return np.flatnonzero(winnow(small, w) & (small != _MAX)), small, windows


class _Block:
    """Fingerprints and windows of a block of the benchmark, by window length."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        codes, bounds = wc.word_codes(texts, wc.LETTERS_DIGITS)
        lengths = np.diff(bounds)
        self.ids, self.classes = ids, {}
        for length in sorted({min(int(x), window) for x in lengths if x}):
            items = np.flatnonzero(np.minimum(lengths, window) == length)
            c = np.concatenate([codes[bounds[i] : bounds[i + 1]] for i in items])
            b = np.concatenate([[0], np.cumsum(lengths[items])]).astype(np.int64)
            at, small, windows = _class_grams(c, b, length)
            whole = np.flatnonzero(np.arange(len(windows)) + length <= wc.gram_ends(b)[: len(windows)])
            pairs = np.unique(np.stack([windows[whole], items[np.repeat(np.arange(len(items)), np.diff(b))[whole]].astype(np.uint64)], 1), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.classes[length] = (np.unique(small[at]), keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether x is in the sorted values, and where."""
    i = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[i] == x, i


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for as many as counts says, then the next."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift


def _match(codes: np.ndarray, bounds: np.ndarray, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Changes in the number of hits at each word, and the distinct pairs of text and item."""
    change = np.zeros(len(codes) + 1, np.int64)
    ends = wc.gram_ends(bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for length, (prints, keys, first, items) in block.classes.items():
        at, small, windows = _class_grams(codes, bounds, length)
        if not len(at):
            continue
        at = at[_member(prints, small[at])[0]]
        _, w = _shape(length)
        starts = np.unique((at[:, None] - np.arange(w)).ravel())
        starts = starts[(starts >= 0) & (starts < len(windows))]
        starts = starts[starts + length <= ends[starts]]
        if not len(starts):
            continue
        hit, i = _member(keys, windows[starts])
        starts, i = starts[hit], i[hit]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        seen = np.unique(np.stack([doc[starts], i], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        n = first[seen[:, 1] + 1] - first[seen[:, 1]]
        found.append(np.stack([np.repeat(seen[:, 0], n), items[_expand(first[seen[:, 1]], n)]], 1))
    return change, (np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, unnamed: bool) -> list:
    """The benchmark as broadcast blocks of bounded size. Items whose id is null are left out unless unnamed."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null" if unnamed else "item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // BLOCK_BYTES))
    out = []
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        table = own.toArrow()
        out.append(spark.sparkContext.broadcast(_Block(table["item"].to_pylist(), table["text"], window)))
        del table
    return out


def _scan(texts: pa.Array, blocks: list) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    codes, bounds = wc.word_codes(texts, wc.LETTERS_DIGITS)
    change, items = np.zeros(len(codes) + 1, np.int64), [set() for _ in range(len(bounds) - 1)]
    for b in blocks:
        block = b.value
        more, pairs = _match(codes, bounds, block)
        change += more
        for d, i in pairs.tolist():
            items[d].add(block.ids[i])
        if len(blocks) > 1:
            b._value = None  # one block at a time in a worker's memory
            del b._value
    return np.cumsum(change[:-1]) > 0, bounds, [sorted(x, key=lambda i: (i is None, i or "")) for x in items]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """What of each document occurs in the benchmark.

    One row per row of docs: its id, n_words, spans (array of first and end word of every maximal hit run) and items
    (ids of the items met, as sorted strings). Null or empty texts have no words and no hits; repeated rows each have
    their row; items without words match nothing, nor do ones with a null
    id unless unnamed, where they are one null at the end of items; equal items are all listed. Other columns are
    not read. With an empty benchmark no document has hits.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, unnamed)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                hit, bounds, items = _scan(part["text"], blocks)
                edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]).astype(np.int8))
                inner = bounds[1:-1]  # runs end with their text
                both = inner[(inner > 0) & (inner < len(hit))]
                both = np.unique(both[hit[both] & hit[both - 1]]) if len(both) else both
                first = np.union1d(np.flatnonzero(edge == 1), both)
                last = np.union1d(np.flatnonzero(edge == -1), both)
                doc = np.searchsorted(bounds, first, "right") - 1
                base = bounds[doc]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], fields=list(span)))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(bounds)), spans, pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])
            wc.release()

    out = own.mapInArrow(run, f"id {id_type}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>")
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, whose text shares no window with the benchmark, whatever its items' ids; null texts stay."""
    blocks = _blocks(benchmark, item_col, item_text_col, window, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            keep = np.ones(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 2048):
                hit, bounds, _ = _scan(texts.slice(at, 2048), blocks)
                total = np.concatenate([[0], np.cumsum(hit)])
                keep[at : at + 2048] = total[bounds[1:]] == total[bounds[:-1]]
            yield batch.filter(pa.array(keep))
            wc.release()

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null),
windows as (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
  from item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
doc_words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w
  from documents),
lengths as (select distinct n from windows),
grams as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g
  from doc_words, lengths, unnest(range(1, len(w) - n + 2)) t(i)),
hits as (select doc_id, i, n, item_id from grams join windows using (n, g)),
covered as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc_words left join covered using (doc_id) left join items using (doc_id)
"""
