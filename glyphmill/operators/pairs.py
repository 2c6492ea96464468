"""All pairs of pages of a source, in blocks of bounded size: shares of letters are compared as arrays, strip by strip."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a block, at most on average, and pairs that are worked on at a time.
BLOCK, PART = 16384, 1 << 19
#: Pages of a block that stand together where pairs are listed by the other's pages: a multiple of 8, so that their numbers, packed in bits, come again at whole bytes.
BESIDE = 64
#: Texts of two blocks that have columns in a table; pages of one block, and of the other, that are compared at a time.
FREQUENT, ROWS, COLUMNS = 1024, 256, 2048


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log2(x + 1e-300)


class Shares:
    """Pages of one block as shares of symbols: those that many pages of either block have in a table, others by symbol."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("doc_id").to_numpy()
        self.langs = rows.column("lang").to_pylist()
        symbols, counts = rows.column("symbols").to_pylist(), [np.frombuffer(c, dtype=np.int64) for c in rows.column("counts").to_pylist()]
        self.row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        self.share = np.concatenate([c / c.sum() for c in counts])
        self.symbol = np.frombuffer("".join(symbols).encode("utf-32-le"), dtype="<u4")

    def table(self, common: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(common, self.symbol), max(len(common) - 1, 0))
        own = common[at] == self.symbol if len(common) else np.zeros(len(at), dtype=bool)
        out = np.zeros((len(self.ids), len(common)))
        out[self.row[own], at[own]] = self.share[own]
        return out

    def rare(self, common: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        own = np.flatnonzero(~np.isin(self.symbol, common))
        own = own[np.argsort(self.symbol[own], kind="stable")]
        parts = np.split(own, np.flatnonzero(np.diff(self.symbol[own])) + 1)
        return {int(self.symbol[x[0]]): (self.row[x], self.share[x]) for x in parts if len(x)}


def strips(a: Shares, b: Shares, same: bool, roots: bool, listed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pages of a, pages of b, value) of pairs that share a symbol, each pair once: with roots the sum of the roots of shares' products, else the divergence. With listed a page of b goes with BESIDE pages of a or more, the same ones for the next, which Parquet packs to next to nothing."""
    met, n = np.unique(np.concatenate([a.symbol, b.symbol]), return_counts=True)
    common = met[n * 8 > len(a.ids) + len(b.ids)]
    p, q, left, right = a.table(common), b.table(common), a.rare(common), b.rare(common)
    rows = max(1, PART // len(b.ids))
    if listed:
        rows = max(BESIDE, rows // BESIDE * BESIDE)
    with_p, with_q = ((x > 0).astype(np.float32) for x in (p, q))
    hp, hq = _h(p).sum(1), _h(q).sum(1)
    by_symbol, p, q = np.ascontiguousarray(q.T), np.sqrt(p) if roots else p, np.sqrt(q) if roots else q
    for low in range(0, len(a.ids), rows):
        high, first = min(low + rows, len(a.ids)), low + 1 if same else 0
        if first >= len(b.ids):
            return
        met = with_p[low:high] @ with_q[first:].T > 0
        if roots:
            value = p[low:high] @ q[first:].T
        else:
            value = np.add.outer(hp[low:high], hq[first:])
            for k in range(len(common)):
                x = np.add.outer(p[low:high, k], by_symbol[k, first:])
                value -= x * np.log2(x + 1e-300)
        for symbol in left.keys() & right.keys():
            (i, x), (j, y) = left[symbol], right[symbol]
            i, x, j, y = i[u := slice(*np.searchsorted(i, [low, high]))] - low, x[u], j[v := slice(np.searchsorted(j, first), None)] - first, y[v]
            if len(i) and len(j):
                value[np.ix_(i, j)] += np.sqrt(np.multiply.outer(x, y)) if roots else np.add.outer(_h(x), _h(y)) - _h(np.add.outer(x, y))
                met[np.ix_(i, j)] = True
        if same:
            met &= np.arange(low, high)[:, None] < np.arange(first, len(b.ids))
        i, j = np.nonzero(met.T)[::-1] if listed else np.nonzero(met)
        yield i + low, j + first, value[i, j] if roots else 1 + value[i, j] / 2


class Counted:
    """Pages of one block as the texts that they hold, with their counts."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("doc_id").to_numpy()
        lists = pc.split_pattern(pa.array([zlib.decompress(x.as_py()) for x in rows.column("symbols").combine_chunks()], pa.large_binary()).cast(pa.large_string()), "\n")
        self.row = np.repeat(np.arange(len(self.ids)), pc.list_value_length(lists).to_numpy())
        self.texts = lists.flatten()
        self.n = np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype=np.int32).astype(np.float64)
        self.square = np.bincount(self.row, self.n * self.n, len(self.ids))


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs, one after another, and the run of each."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) + np.repeat(start - np.cumsum(size) + size, size)


def cosines(a: Counted, b: Counted, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pages of a, pages of b, cosine) of pairs with a cosine of least and more, each pair once: frequent texts by tables, the others by the pages that hold them. Sums are of whole numbers, so exact."""
    coded = pa.chunked_array([a.texts] if same else [a.texts, b.texts]).dictionary_encode().combine_chunks()
    code = coded.indices.to_numpy().astype(np.int64)
    left, right = code[: len(a.texts)], code[-len(b.texts) :]
    df = np.bincount(code)
    listed = np.argsort(-df, kind="stable")[:FREQUENT]
    column = np.full(len(df), -1)
    column[listed] = np.arange(len(listed))
    table = lambda x, code: (x.row[own := np.flatnonzero(column[code] >= 0)], column[code[own]], x.n[own])
    full = np.zeros((len(b.ids), len(listed)), dtype=np.float32)  # counts are below 2**24
    row, at, n = table(b, right)
    full[row, at] = n
    rare = np.flatnonzero(column[right] < 0)
    rare = rare[np.argsort(right[rare], kind="stable")]
    held = np.bincount(right[rare], minlength=len(df))
    first = np.cumsum(held) - held
    row, at, n = table(a, left)
    alone = np.flatnonzero((column[left] < 0) & (held[left] > 0))
    rows = min(ROWS, max(16, PART // len(b.ids)))
    for low in range(0, len(a.ids), rows):
        high, begin = min(low + rows, len(a.ids)), low + 1 if same else 0
        if begin >= len(b.ids):
            return
        own = slice(*np.searchsorted(row, [low, high]))
        mine = np.zeros((high - low, len(listed)))
        mine[row[own] - low, at[own]] = n[own]
        value = np.empty((high - low, len(b.ids) - begin))
        for k in range(begin, len(b.ids), COLUMNS):
            value[:, k - begin : k - begin + COLUMNS] = mine @ full[k : k + COLUMNS].astype(np.float64).T
        some = alone[slice(*np.searchsorted(a.row[alone], [low, high]))]
        size = held[left[some]]
        ends = np.cumsum(size)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PART * 4, int(ends[-1]) if len(ends) else 0, PART * 4)) + 1, [len(some)]]))
        for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            run, place = _spread(first[left[some[u:v]]], size[u:v])
            x, y = some[u:v][run], rare[place]
            beyond = b.row[y] >= begin
            x, y = x[beyond], y[beyond]
            value += np.bincount((a.row[x] - low) * value.shape[1] + b.row[y] - begin, a.n[x] * b.n[y], value.size).reshape(value.shape)
        value /= np.sqrt(np.multiply.outer(a.square[low:high], b.square[begin:]))
        met = value >= least
        if same:
            met &= np.arange(low, high)[:, None] < np.arange(begin, len(b.ids))
        i, j = np.nonzero(met)
        for k in range(0, len(i), PART // 8):
            x, y = i[k : k + PART // 8], j[k : k + PART // 8]
            yield x + low, y + begin, value[x, y]


def in_blocks(profiles: DataFrame, f: Callable[[str, Shares, Shares, bool], Iterator[pa.RecordBatch]], schema: str, kind: type = Shares, pages: DataFrame | None = None) -> DataFrame:
    """f of each two blocks of a source, or of one: (source, blocks, whether they are one). profiles: (doc_id, lang, source, symbols, counts), read twice, unless pages, of no fewer rows, are counted in their place."""
    blocks = (profiles if pages is None else pages).where("source is not null").groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = profiles.join(blocks, "source").withColumn("own", F.expr("pmod(xxhash64(doc_id), blocks)"))
    pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("source", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("first"), "doc_id", "lang", "symbols", "counts")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).sort_by("doc_id")
        same = key[1].as_py() == key[2].as_py()
        parts = [group, group] if same else [group.filter(group.column("first")), group.filter(pc.invert(group.column("first")))]
        if all(len(x) for x in parts):
            yield from f(key[0].as_py(), *map(kind, parts), same)

    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "source", "i", "j").groupBy("source", "i", "j").applyInArrow(run, schema)
