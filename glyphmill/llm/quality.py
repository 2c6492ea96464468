"""Document quality by a sparse rule ensemble.

Statistics of each text (counts of characters, words, repetitions; nothing else of the row) feed boosted shallow trees,
fitted on labelled rows. Every path from a root to a node is a rule: a conjunction of comparisons. A logistic
regression with an L1 penalty over all rules keeps a few of them with weights, and these compile into one Spark column
expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.scratch import cut, fresh_name, small_batches

#: Labelled rows that a model is fitted on, about; a documented bound.
SAMPLE = 8_000
#: Scores from which a document counts as good.
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 32
PENALTIES = (0.01, 0.003, 0.001, 0.0003)

_CLASSES = ("upper", "lower", "digit", "space", "line", "stop", "shout", "symbol", "mark", "wide")
_class = np.full(256, _CLASSES.index("symbol"), np.int64)
_class[65:91] = _CLASSES.index("upper")
_class[97:123] = _CLASSES.index("lower")
_class[48:58] = _CLASSES.index("digit")
_class[[9, 11, 12, 13, 32]] = _CLASSES.index("space")
_class[10] = _CLASSES.index("line")
_class[[ord(c) for c in ".,;:'\"-()"]] = _CLASSES.index("mark")
_class[ord(".")] = _CLASSES.index("stop")
_class[[ord("!"), ord("?")]] = _CLASSES.index("shout")
_class[128:] = _CLASSES.index("wide")

#: Statistics in the order of the array that text_statistics() makes.
STATISTICS = (
    "bytes", "words", "word_bytes", "upper_share", "digit_share", "space_share", "stop_per_word", "shout_per_word",
    "symbol_per_word", "mark_per_word", "wide_share", "lines", "line_words", "distinct_words", "top_word_share",
    "distinct_shingles", "equal_neighbours", "long_words", "bare_words",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; all are finite, and 0 for null and empty texts."""
    data, off = wc.text_bytes(texts)
    n = len(off) - 1
    counts = np.zeros((n, len(_CLASSES)))
    doc_of = np.repeat(np.arange(n), np.diff(off))
    for s in range(0, len(data), 1 << 20):
        key = doc_of[s : s + (1 << 20)] * len(_CLASSES) + _class[data[s : s + (1 << 20)]]
        low = int(key[0]) // len(_CLASSES) * len(_CLASSES)
        found = np.bincount(key - low).astype(float)
        counts.ravel()[low : low + len(found)] += found
    codes, bounds, starts, ends = wc.word_codes(texts, wc.NOT_SPACE, places=True)
    words = np.diff(bounds).astype(float)
    size = np.diff(off).astype(float)
    distinct, top = np.zeros(n), np.zeros(n)
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            own = np.sort(codes[a:b])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[d], top[d] = len(edge) - 1, np.diff(edge).max()
    _, shingles = wc.shingle_sets(codes, bounds, 5)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) if len(codes) else np.zeros(0, np.int64)
    per_doc = lambda at: np.bincount(doc[at], minlength=n).astype(float)
    lengths = ends - starts
    letter = np.concatenate([[0], np.cumsum(np.isin(_class[data], [_CLASSES.index(c) for c in ("upper", "lower", "digit", "wide")]))]) if len(data) else np.zeros(1, np.int64)
    bare = np.flatnonzero(letter[ends] == letter[starts]) if len(starts) else np.zeros(0, np.int64)
    c = {k: counts[:, i] for i, k in enumerate(_CLASSES)}
    over = lambda a, b: a / np.maximum(b, 1)
    lines = np.where(size > 0, c["line"] + 1, 0)
    return np.stack([
        size, words, over(size - c["space"] - c["line"], words), over(c["upper"], c["upper"] + c["lower"]), over(c["digit"], size), over(c["space"], size), over(c["stop"], words), over(c["shout"], words),
        over(c["symbol"], words), over(c["mark"], words), over(c["wide"], size), lines, over(words, lines), over(distinct, words), over(top, words),
        over(np.diff(shingles), np.maximum(words - 4, 1)) * (words > 0), over(per_doc(same), words), over(per_doc(np.flatnonzero(lengths > 24)), words), over(per_doc(bare), words),
    ], 1)


def text_statistics(docs: DataFrame, text_col: str = "text", name: str = "_statistics", keep: list[str] | None = None) -> DataFrame:
    """docs, with the columns of keep or all, and an array of STATISTICS."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at, kept = docs.columns.index(text_col), [i for i, c in enumerate(docs.columns) if c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                x = statistics(part.column(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], lists], [*[f.name for f in fields], name])
            wc.release()

    return docs.mapInArrow(run, schema)


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return cut(text_statistics(own, "_text", keep=[id_col]), "statistics")


# --- fitting -------------------------------------------------------------------------------------------------------

#: A rule: (statistic, threshold, above), and of these.
Rule = tuple[tuple[int, float, bool], ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, t, above in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def _tree_paths(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Rules for all nodes but the root of a tree grown on Newton steps, and the tree's values."""
    rules, value = [], np.zeros(len(bins))

    def grow(rows: np.ndarray, rule: Rule) -> None:
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, None, None)
        if len(rule) < DEPTH and len(rows) >= 20:
            for f in range(bins.shape[1]):
                k = len(cuts[f])
                if not k:
                    continue
                gs = np.bincount(bins[rows, f], gradient[rows], k + 1).cumsum()[:-1]
                hs = np.bincount(bins[rows, f], weight[rows], k + 1).cumsum()[:-1]
                ns = np.bincount(bins[rows, f], minlength=k + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 5) | (len(rows) - ns < 5)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], f, i)
        if best[1] is None:
            value[rows] = g / (h + 1)
            return
        _, f, i = best
        t = float(cuts[f][i])
        left = bins[rows, f] <= i
        for part, above in ((rows[left], False), (rows[~left], True)):
            longer = tuple(sorted({*rule, (f, t, above)}))
            rules.append(longer)
            grow(part, longer)

    grow(np.arange(len(bins)), ())
    return rules, value


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n = len(y)
    probe = np.ones(a.shape[1])
    for _ in range(12):
        probe = a.T @ (a @ probe)
        probe /= np.linalg.norm(probe) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(a @ probe) ** 2 / n + 1) + 1e-9)
    w, b = start
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = _sigmoid(a @ v + c) - y
        new = v - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, t = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b), t2
        w, b = new, new_b
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + sum((w * _holds(r, x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x))))

    def column(self, statistics: Column) -> Column:
        """The score as a column over an array of STATISTICS."""
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            tests = [(statistics[f] > F.lit(t)) if above else (statistics[f] <= F.lit(t)) for f, t, above in rule]
            holds = tests[0]
            for other in tests[1:]:
                holds = holds & other
            total = total + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total))))


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Without rows the score is 1/2; with rows of one label only it is that label's share, smoothed; with rows that no tree parts, their share."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = y.mean()
    z, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = _sigmoid(z)
        paths, value = _tree_paths(bins, cuts, y - p, np.maximum(p * (1 - p), 1e-6))
        z += RATE * value
        rules |= dict.fromkeys(paths)
    kept, seen = [], set()
    for r in rules:  # rules that hold for the same rows are one
        mark = np.packbits(_holds(r, x)).tobytes()
        if mark not in seen:
            seen.add(mark)
            kept.append(r)
    if not kept:  # too few rows for a tree
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    a = np.stack([_holds(r, x) for r in kept], 1).astype(np.float32)
    fold = np.arange(len(y)) % 5 == 4
    at, best = (np.zeros(a.shape[1]), float(np.log(share / (1 - share)))), (np.inf, PENALTIES[0])
    for penalty in PENALTIES:
        at = _lasso(a[~fold], y[~fold], penalty, at)
        p = _sigmoid(a[fold] @ at[0] + at[1])
        loss = -np.mean(np.where(y[fold] > 0, np.log(p), np.log1p(-p)))
        best = min(best, (loss, penalty))
    w, b = _lasso(a, y, best[1], (np.zeros(a.shape[1]), float(np.log(share / (1 - share)))), 400)
    on = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble([kept[i] for i in on], [float(w[i]) for i in on], float(b))


def _chosen(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y): about SAMPLE labelled rows, chosen by a hash of the id, none held out. Null labels don't count."""
    own = labels.where(f"{label_col} is not null").select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    own = own.where(~held_out("_id"))
    return own.where(F.pmod(F.xxhash64(F.lit(8), "_id"), F.lit(max(1, own.count() // SAMPLE))) == 0)


def fit_quality(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", name: str = "_statistics") -> RuleEnsemble:
    """A model from the labelled rows of statistics that aren't held out.

    Takes about SAMPLE of them, chosen by a hash of the id. Labels that are null or name no row of statistics don't
    count; a row with several labels counts once for each.
    """
    chosen = _chosen(labels, id_col, label_col)
    rows = statistics.select(F.col(id_col).alias("_doc"), name).join(chosen, F.col("_doc") == F.col("_id")).select("_id", "_y", name).toArrow()
    x = np.array(rows[name].to_pylist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T[::-1], rows["_y"].to_numpy(), rows["_id"].to_numpy()))
    return fit_rules(x[order], rows["_y"].to_numpy()[order])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score) for every row of docs. Null and empty texts have statistics of 0 and the score that follows; no rows give none."""
    table = _table(docs, id_col, text_col)
    model = fit_quality(table, labels, id_col, label_col)
    return table.select(id_col, held_out(id_col).alias("held_out"), model.column(F.col("_statistics")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score threshold or more.

    Statistics are made of the labelled sample first, which is found by its ids (about SAMPLE, so they are sent to all),
    and then once of all rows, as they are filtered.
    """
    ids = F.broadcast(_chosen(labels, id_col, label_col).select("_id").distinct())
    sample = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(ids, F.col("_doc") == F.col("_id"), "left_semi")
    model = fit_quality(text_statistics(sample, "_text", keep=["_doc"]).withColumnRenamed("_doc", id_col), labels, id_col, label_col)
    name = fresh_name(docs, "_statistics")
    return text_statistics(docs, text_col, name).where(model.column(F.col(name)) >= threshold).drop(name)


def op8(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
