"""Cuts that depend on where the one before fell: chunks, packed lines, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.keyed import seeded


def line_packing(tk: DataFrame, sims: int = 200, least: int = 8) -> DataFrame:
    """Slack of lines against the page's 90th percentile width, over that of lines packed from its shuffled words. Pages of fewer lines than least are left out."""

    def packed(sizes: np.ndarray, width: float) -> list[int]:
        """Widths of lines that take words of these sizes, with a blank between two, as long as they fit."""
        upto = np.concatenate([[0], np.cumsum(sizes + 1)])
        # where a line that begins with each word ends: one word at least
        nexts = np.maximum(np.searchsorted(upto, upto[:-1] + width + 1 + 1e-9, "right") - 1, np.arange(len(sizes)) + 1).tolist()
        out, k = [], 0
        while nexts[k] < len(sizes):  # the last line may be short
            out.append(int(upto[nexts[k]] - upto[k]) - 1)
            k = nexts[k]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_no", "pos"])
        width = pdf.assign(w=pdf.tok.str.len() + 1).groupby("line_no").w.sum() - 1
        if len(width) < least:
            return pd.DataFrame([], columns=["lang", "doc_id", "slack", "chance"])
        w = float(np.percentile(width, 90))
        rng, sizes, means = seeded("pack", pdf.doc_id.iloc[0]), pdf.tok.str.len().to_numpy(), []
        for _ in range(sims):
            rows = np.array(packed(rng.permutation(sizes), w))
            if len(rows) >= 2:
                means.append(np.maximum(0, np.percentile(rows, 90) - rows).mean())
        if not means:
            return pd.DataFrame([], columns=["lang", "doc_id", "slack", "chance"])
        return pd.DataFrame([(pdf.lang.iloc[0], pdf.doc_id.iloc[0], float(np.maximum(0, w - width).sum()), float(np.mean(means)) * len(width))], columns=["lang", "doc_id", "slack", "chance"])

    pages = tk.select("lang", "doc_id", "line_no", "pos", "tok").groupBy("doc_id").applyInPandas(run, "lang string, doc_id long, slack double, chance double")
    return pages.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.round(F.sum("slack") / F.sum("chance"), 6).alias("ratio"))


def _cuts(e: np.ndarray, most: int) -> list[list[int]]:
    """Cuts of pages in order into 1, 2, ... most blocks, each added where pairs of one block and of two, told by their means, are then told best.

    e: symmetric, 0 on its diagonal. Sums of any two blocks' pairs follow from sums over rows and columns.
    """
    n = len(e)
    upto = np.zeros((n + 1, n + 1))
    upto[1:, 1:] = e.cumsum(0).cumsum(1)
    total, pairs = upto[n, n] / 2, n * (n - 1) / 2
    same, k, cuts, out = total, pairs, [], [[]]
    for _ in range(min(most, n) - 1):
        edges = np.array([0, *sorted(cuts), n])
        at = np.setdiff1d(np.arange(1, n), cuts)
        low, high = edges[np.searchsorted(edges, at, "right") - 1], edges[np.searchsorted(edges, at, "right")]
        # the pairs that a cut sets apart
        s = same - (upto[at, high] - upto[low, high] - upto[at, at] + upto[low, at])
        m = k - (at - low) * (high - at)
        told = np.where(m > 0, s**2 / np.maximum(m, 1), 0) + (total - s) ** 2 / (pairs - m)
        best = int(np.argmax(np.round(told, 12)))
        same, k = s[best], m[best]
        cuts.append(int(at[best]))
        out.append(sorted(cuts))
    return out


def _block_means(e: np.ndarray, cuts: list[int]) -> tuple[float, float]:
    """Mean of the pairs of one block, and of two; the one that there are none of is the other."""
    own = np.searchsorted(cuts, np.arange(len(e)), "right")
    i, j = np.triu_indices(len(e), 1)
    apart, x = own[i] != own[j], e[i, j]
    inside, across = x[~apart], x[apart]
    a = inside.mean() if len(inside) else across.mean()
    return float(a), float(across.mean()) if len(across) else float(a)


def _told(pages: np.ndarray, cuts: list[int], means: tuple[float, float], page: int) -> np.ndarray:
    """What blocks say of the pairs of a page that is left out; it belongs to the block of the page before it."""
    own = np.searchsorted(cuts, np.arange(len(pages)), "right")
    before = max(0, int(np.searchsorted(pages, page)) - 1)
    return np.where(own == own[before], *means)


def step_errors(e: np.ndarray, folds: np.ndarray, most: int = 6, parts: int = 5) -> tuple[float, np.ndarray]:
    """Square error of each page's pairs, told by blocks that are fitted without it, and how many blocks that took: 2 to most, by folds of the others."""
    n, error, taken = len(e), 0.0, np.zeros(len(e), int)
    for p in range(n):
        rest = np.delete(np.arange(n), p)
        fold, wrong = np.argsort(np.argsort(np.delete(folds[p], p), kind="stable"), kind="stable") % parts, np.zeros(most + 1)
        for f in range(parts):
            used = rest[fold != f]
            path = _cuts(e[np.ix_(used, used)], most)
            for k in range(2, most + 1):
                if k > len(path):
                    wrong[k] = np.inf
                    continue
                means = _block_means(e[np.ix_(used, used)], path[k - 1])
                wrong[k] += sum(float(((_told(used, path[k - 1], means, q) - e[q, used]) ** 2).sum()) for q in rest[fold == f])
        taken[p] = 2 + int(np.argmin(np.round(wrong[2:], 12)))
        path = _cuts(e[np.ix_(rest, rest)], most)
        cuts = path[min(taken[p], len(path)) - 1]
        error += float(((_told(rest, cuts, _block_means(e[np.ix_(rest, rest)], cuts), p) - e[p, rest]) ** 2).sum())
    return error, taken


def drift_segmentation(xs: DataFrame, least: int = 10, most: int = 6) -> DataFrame:
    """Whether change along a run's pages comes in steps: the error of blocks over that of a line, each page's pairs told without it (T5). Under 1: steps.

    xs has excess divergences (lang, run, i, j, x); runs are short, so a group is a small matrix. Runs of fewer pages
    than least are left out. The number of blocks, 2 to most, is chosen by five folds for every page; segments is the one chosen most often,
    cuts are where the whole run's blocks begin.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["lang", "run", "pages", "segments", "cuts", "step_error", "line_error", "shape"]
        n = int(pdf.j.max()) + 1
        if n < least:
            return pd.DataFrame([], columns=names)
        e = np.zeros((n, n))
        e[pdf.i, pdf.j] = pdf.x
        e += e.T
        lang, number = pdf.lang.iloc[0], int(pdf.run.iloc[0])
        step, taken = step_errors(e, seeded("t5", lang, number).random((n, n)), most)
        line = 0.0
        for p in range(n):
            rest = np.delete(np.arange(n), p)
            i, j = np.triu_indices(n - 1, 1)
            b, a = np.polyfit(np.abs(rest[j] - rest[i]).astype(float), e[rest[i], rest[j]], 1)
            line += float(((a + b * np.abs(rest - p) - e[p, rest]) ** 2).sum())
        k = int(np.bincount(taken).argmax())
        cuts = ",".join(map(str, _cuts(e, most)[k - 1]))
        return pd.DataFrame([(lang, number, n, k, cuts, round(step, 6), round(line, 6), round(step / line, 6) if line else None)], columns=names)

    return xs.groupBy("lang", "run").applyInPandas(run, "lang string, run long, pages long, segments long, cuts string, step_error double, line_error double, shape double")


def drift_shape(xs: DataFrame) -> DataFrame:
    """T5 of a language: the errors of all its runs together."""
    runs = drift_segmentation(xs).groupBy("lang").agg(F.count(F.lit(1)).alias("runs"), F.sum("pages").alias("pages"), F.sum("step_error").alias("s"), F.sum("line_error").alias("l"))
    return runs.select("lang", "runs", "pages", F.round(F.col("s") / F.col("l"), 6).alias("shape"))
