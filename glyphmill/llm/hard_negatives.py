"""Hard negatives by inverted lists: k-means cells with the radii of what is in them, visited by Cauchy-Schwarz bounds.

A row x of a cell with centroid c and radius r scores a.x with an anchor a, and |a.x - a.c| <= |a| r. An anchor first
visits the PROBES cells of the highest upper bounds. What it found there gives its k-th score, and it then visits the
cells whose upper bound isn't strictly below that, and no others. That is done twice: for the best rows of its own label
(its positives), and then, within the windows of scores which these give, for rows of other labels; cells that lie
outside all windows are skipped. Results are exact whatever the centroids are.

Cells are dealt in parts of ROWS rows and COLS visiting anchors, so a cell of very many equal vectors, or one that all
anchors visit, is many groups. Scores are inner products of whole numbers, in doubles where these hold them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.scratch import cut, drop

POSITIVES, NEGATIVES = 5, 10
#: Scores of negatives, in hundredths of their positive's.
LOW, HIGH = 30, 90
#: What a component of 1 becomes.
SCALE = 256
#: Rows of a cell on average. Tables of fewer than twice as many are one cell.
CELL = 1024
#: Bytes of all centroids of a length at most, a bound for what is broadcast.
CENTROID_BYTES = 64 << 20
#: Cells from which on rows find theirs through coarse ones.
COARSE = 1024
#: Rows that centroids are fitted on, at most; bytes of them at most.
SAMPLE, SAMPLE_BYTES = 1 << 17, 64 << 20
#: Cells that an anchor visits before it has a k-th score.
PROBES = 4
#: Rows of a cell, and anchors that visit it, compared in one block, in tiles of so many anchors.
ROWS, COLS, TILE = 4096, 4096, 256

_NO_SCORE = np.iinfo(np.int64).min


def most(dim: int) -> int:
    """Components are kept within this: beyond, scores would not fit a long."""
    return min(math.isqrt(2**62 // dim), 2**31 - 1)


def quantised(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of floor(SCALE x) as whole doubles, and which vectors have one: those of dim finite components."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = lengths == dim
    at = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1][ok]
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    rows = flat[at[:, None] + np.arange(dim)]
    good = np.isfinite(rows).all(axis=1)
    ok[np.flatnonzero(ok)[~good]] = False
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows[good] * SCALE), -most(dim), most(dim)), ok


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k centroids of the rows of x; fewer if x has fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = np.square(c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[s : s + 4096] @ c.T, axis=1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Cells:
    """Centroids of vectors of one length, in two levels if there are many."""

    def __init__(self, sample: np.ndarray, k: int):
        if k <= COARSE:
            self.coarse, self.fine = None, kmeans(sample, k)
        else:
            self.coarse = kmeans(sample, round(math.sqrt(k)))
            own = nearest(sample, self.coarse)
            parts = [kmeans(sample[own == c], max(1, round(k * float(np.mean(own == c))))) if np.any(own == c) else self.coarse[c : c + 1] for c in range(len(self.coarse))]
            self.fine, self.edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def home(self, x: np.ndarray) -> np.ndarray:
        if self.coarse is None:
            return nearest(x, self.fine)
        top = nearest(x, self.coarse)
        out = np.empty(len(x), np.int64)
        for c in np.unique(top).tolist():
            out[top == c] = self.edges[c] + nearest(x[top == c], self.fine[self.edges[c] : self.edges[c + 1]])
        return out


def _scan(shared, first: dict[int, int]):
    """Rows that take part, with their cell and how far they are from its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lengths = part["embedding"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths[lengths > 0]).tolist():
                    x, ok = quantised(part["embedding"], dim)
                    keep = pa.array(np.flatnonzero(ok))
                    cells = shared.value[dim]
                    home = cells.home(x)
                    far = np.linalg.norm(x - cells.fine[home], axis=1) if len(x) else np.zeros(0)
                    kept = [part[c].take(keep) for c in ("id", "label", "anchor")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([v.astype(np.int32).tobytes() for v in x], pa.binary()), pa.array((first[dim] + home).astype(np.int32)), pa.array(far)], ["id", "label", "anchor", "vector", "cell", "far"])

    return run


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), -1).astype(np.float64)


def _visits(shared, first: dict[int, int]):
    """Cells that anchors visit: the most promising, or, for those that have done so, all the rest that their scores so far leave open.

    kth, low and high are arrays: a cell is open if for some i its upper bound is at least max(kth[i], low[i]) and its
    lower bound at most high[i].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["vector"].to_pylist()
            out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
            lengths = np.array([len(v) // 4 for v in raw], np.int64)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                c, radius = shared.value[dim]
                x = _matrix([raw[i] for i in own])
                middle = x @ c.T
                slack = np.linalg.norm(x, axis=1)[:, None] * radius
                # rounding of the bounds themselves
                slack = slack + 1e-9 * (np.abs(middle) + slack) + 1e-6
                upper, lower = middle + slack, middle - slack
                windows = zip(*(batch[n].take(pa.array(own)).to_pylist() for n in ("kth", "low", "high", "done")))
                for i, top, bottom, (kth, low, high, done) in zip(own.tolist(), upper, lower, windows):
                    floor = np.maximum(np.array(kth), np.array(low))
                    open_ = np.flatnonzero(((bottom[:, None] <= np.array(high)) & (top[:, None] >= floor)).any(axis=1) & (radius >= 0))
                    out[i] = first[dim] + open_[np.lexsort((open_, -top[open_]))[:PROBES]] if done is None else np.setdiff1d(first[dim] + open_, done)
            edges = np.concatenate([[0], np.cumsum([len(v) for v in out])]).astype(np.int32)
            cells = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0, np.int32), *out]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in batch.schema.names[:-1]), cells], [*batch.schema.names[:-1], "cells"])

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64."""
    if a.shape[1] * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the columns at, the k of the highest scores, smaller ids first among equals."""
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _blocks(same: bool, k: int):
    """The k best of each anchor in a block of a cell: of its label, or, for each of its windows, of others."""

    def block(x: dict) -> pa.RecordBatch | None:
        own, other = x["side"] == 1, x["side"] == 0
        if not own.any() or not other.any():
            return None
        a, b = _matrix(x["vector"][own]), _matrix(x["vector"][other])
        nums, labels, wanted = x["num"][own], x["label"][own], [x[n][own] for n in ("kth", "low", "high")]
        ids, rows, kinds = x["id"][other], x["num"][other], x["label"][other]
        out: list[tuple] = []
        for s in range(0, len(a), TILE):
            scores = _products(a[s : s + TILE], b)
            for j, score in enumerate(scores, s):
                fit = (kinds == labels[j]) == same
                if same:
                    fit &= rows != nums[j]
                for w, (kth, low, high) in enumerate(zip(*(v[j] for v in wanted))):
                    at = np.flatnonzero(fit & (score >= max(kth, low)) & (score <= high))
                    at = _best(score, ids, at, k)
                    out += zip([int(nums[j])] * len(at), [w] * len(at), score[at].tolist(), ids[at].tolist(), rows[at].tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["num", "window", "score", "found", "row"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
            held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
            edge = np.flatnonzero((np.diff(held["cell"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
            for s, e in zip([0, *edge[:-1].tolist()], edge.tolist()):
                if (out := block({c: v[s:e] for c, v in held.items()})) is not None:
                    yield out
            if len(edge):
                held = {c: v[edge[-1] :] for c, v in held.items()}
        if held is not None and len(held["num"]) and (out := block(held)) is not None:
            yield out

    return run


_ANCHOR = "num bigint, id bigint, label bigint, vector binary, kth array<bigint>, low array<bigint>, high array<bigint>"
_FOUND = "num bigint, window int, score bigint, found bigint, row bigint"


def _search(anchors: DataFrame, rows: DataFrame, cells: DataFrame, lists, first: dict[int, int], same: bool, k: int) -> DataFrame:
    """The k best rows for each window of each anchor: (num, window, rank, score, found, row)."""

    def visit(who: DataFrame) -> tuple[DataFrame, DataFrame]:
        went = cut(who.mapInArrow(_visits(lists, first), f"{_ANCHOR}, cells array<int>"), "visits")
        seen = went.withColumn("cell", F.explode("cells")).drop("cells")
        deal = F.broadcast(cells.join(seen.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / COLS).alias("cols")), "cell"))  # a row per cell
        part, none = F.xxhash64(F.lit(3), "num"), F.array().cast("array<bigint>")
        zero = F.lit(0).cast("bigint")
        members = rows.join(deal, "cell").select("cell", F.pmod(part, "parts").alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"), "num", "id", "label", "vector", none.alias("kth"), none.alias("low"), none.alias("high"))
        visitors = seen.join(deal, "cell").select("cell", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), F.pmod(part, "cols").alias("j"), F.lit(1).alias("side"), "num", "id", "label", "vector", "kth", "low", "high")
        dealt = members.union(visitors).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        return went, cut(dealt.mapInArrow(_blocks(same, k), _FOUND), "candidates")

    ranked = F.row_number().over(Window.partitionBy("num", "window").orderBy(F.desc("score"), "found", "row"))
    went, near = visit(anchors.withColumn("done", F.lit(None).cast("array<int>")))
    best = near.withColumn("rank", ranked).where(F.col("rank") <= k)
    worst = best.where(F.col("rank") == k).groupBy(F.col("num").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kths"))
    told = went.join(worst, F.col("num") == F.col("n"), "left").withColumn("kth", F.transform("kth", lambda x, i: F.coalesce(F.col("kths")[i], x)))
    _, far = visit(told.select(*anchors.columns, F.col("cells").alias("done")))
    return cut(near.union(far).withColumn("rank", ranked).where(F.col("rank") <= k), "best")


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor holds.

    A row's score is the inner product with the anchor, components being floor(SCALE x). An anchor's positives are its
    first other rows of the same label, its negatives for one the first rows of other labels whose score is low to high
    hundredths of the positive's; higher scores come first, then smaller ids. Ids and labels are integers.
    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; components of
    which scores would not fit a long count as the largest that do. Vectors of each length are compared among themselves. Each row counts for itself, also where ids
    repeat: another row of an anchor's id is another row. Anchors without positives, and positives without negatives, have
    no rows; nor have empty tables. Other columns are read by anchor and label alone.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.where("id is not null and embedding is not null and label is not null")
    by_length = own.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 0").orderBy("dim").collect()  # a row per length
    lists, first, n_cells = {}, {}, 0
    for dim, total in by_length:
        k = max(1, int(min(total // CELL, CENTROID_BYTES // (8 * dim))))
        bound = max(k, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        chosen = own.where(F.size("embedding") == dim).where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, total // bound))) == 0).select("embedding").limit(2 * bound).toArrow() if k > 1 else None
        x = quantised(chosen["embedding"].combine_chunks(), dim)[0] if chosen is not None else np.zeros((0, dim))
        lists[dim] = Cells(x if len(x) else np.zeros((1, dim)), k)
        first[dim], n_cells = n_cells, n_cells + len(lists[dim].fine)
    rows = own.mapInArrow(_scan(spark.sparkContext.broadcast(lists), first), "id bigint, label bigint, anchor boolean, vector binary, cell int, far double")
    rows = cut(rows.withColumn("num", F.monotonically_increasing_id()), "listed-vectors")
    held = rows.groupBy("cell").agg(F.max("far").alias("far"), F.ceil(F.count(F.lit(1)) / ROWS).alias("parts"))
    cells = held.select("cell", "parts")
    far = {r["cell"]: r["far"] for r in held.collect()}  # a row per cell; CENTROID_BYTES bounds them
    bounds = {dim: (c.fine, np.array([far.get(first[dim] + i, -1.0) for i in range(len(c.fine))])) for dim, c in lists.items()}
    bounds = spark.sparkContext.broadcast(bounds)

    least, top = F.lit(_NO_SCORE).cast("bigint"), F.lit(np.iinfo(np.int64).max).cast("bigint")
    anchors = cut(rows.where("anchor").select("num", "id", "label", "vector", F.array(least).alias("kth"), F.array(least).alias("low"), F.array(top).alias("high")), "anchors")
    good = _search(anchors, rows, cells, bounds, first, True, positives)
    # 100 n >= low p and 100 n <= high p, in whole numbers: a window from the ceiling to the floor
    exact = F.col("score").cast("decimal(20,0)")
    windows = good.select("num", "rank", F.ceil(exact * low / 100).cast("bigint").alias("low"), F.floor(exact * high / 100).cast("bigint").alias("high"))
    each = windows.groupBy(F.col("num").alias("n")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asked = anchors.join(each, F.col("num") == F.col("n")).select("num", "id", "label", "vector", F.transform("w", lambda x: least).alias("kth"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    bad = _search(asked, rows, cells, bounds, first, False, negatives)
    pairs = good.select(F.col("num").alias("n"), (F.col("rank") - 1).alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.join(pairs, (F.col("num") == F.col("n")) & (F.col("window") == F.col("w"))).join(anchors.select(F.col("num").alias("a"), F.col("id").alias("anchor_id")), F.col("num") == F.col("a"))
    out = cut(out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    drop(good, bad, rows)
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


OP12_SQL = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) e, row_number() over () i
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id anchor_id, a.i a, b.vec_id id, b.i b, a.l = b.l same, list_dot_product(a.e, b.e)::bigint score
  from v a join v b on a.i <> b.i and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
positives as (select *, row_number() over (partition by a order by score desc, id, b) p from scores where same qualify p <= 5)
select p.anchor_id, p.id positive_id, (row_number() over (partition by p.a, p.b order by n.score desc, n.id, n.b))::int "rank",
  n.id negative_id, p.score positive_score, n.score negative_score
from positives p join scores n on n.a = p.a and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify "rank" <= 10
"""
