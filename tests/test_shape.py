"""Floors, chunks, drift, fits and permutation tests against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.dialect import SPARK
from glyphmill.operators import cutting, searching
from glyphmill.sources import corpus
from glyphmill.sources.chunks import hand_chunks


def test_the_floor_is_the_expectation(spark):
    """Against the double sum over both binomials."""
    cases = [(100, 100, 1), (100, 1500, 1), (150, 300, 5), (150, 600, 30), (90, 90, 90), (101, 5, 1)]
    rows = spark.createDataFrame([(n, float(i), float(j), k / (i + j)) for n, (i, j, k) in enumerate(cases)], "n int, ni double, nj double, q double")
    got = spark.sql(corpus.integrand(SPARK, "select * from {rows}"), rows=rows).groupBy("n").agg((F.sum("term") / 2).alias("x")).collect()
    got = {r.n: r.x for r in got}

    def pmf(n: int, p: float) -> np.ndarray:
        k = np.arange(n + 1)
        logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])
        return np.exp(logs + k * math.log(p) + (n - k) * math.log1p(-p))

    for n, (i, j, k) in enumerate(cases):
        p = k / (i + j)
        a, b = np.arange(i + 1)[:, None] / i, np.arange(j + 1)[None, :] / j
        m = (a + b) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(a > 0, a * np.log(a / m), 0) / 2 + np.where(b > 0, b * np.log(b / m), 0) / 2
        assert got[n] == pytest.approx(float((pmf(i, p)[:, None] * pmf(j, p)[None, :] * each).sum()), abs=1e-8)


@pytest.mark.parametrize("size", [7, 50])
def test_chunks_are_those_of_one_pass(spark, size):
    r = random.Random(size)
    lines = [(lang, doc, n, ["w"] * r.choice([0, 1, 1, 2, 3, 9, 60 if r.random() < 0.1 else 4])) for lang in ("a", "b") for doc in range(5000 * (lang == "b"), 5000 * (lang == "b") + 40) for n in range(r.randint(0, 9))]
    lines += [("c", 9, 0, ["w"]), ("d", 8, 0, [])]
    lw = spark.createDataFrame(lines, "lang string, doc_id bigint, line_no int, words array<string>").repartition(3)
    expected = set()
    for lang in "abcd":
        own, held, total = [x for x in sorted(lines, key=lambda x: x[:3]) if x[0] == lang and x[3]], [], 0
        start = 0
        for at, (_, doc, n, words) in enumerate(own):
            held.append((doc, n, at))
            total += len(words)
            if total >= size:
                expected |= {(lang, d, m, start, k - start) for d, m, k in held}
                held, total, start = [], 0, at + 1
    got = [tuple(x) for x in hand_chunks(lw, size).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert hand_chunks(lw.limit(0), size).count() == 0


def brute_path(e: np.ndarray, most: int) -> list[list[int]]:
    n = len(e)
    i, j = np.triu_indices(n, 1)

    def error(cuts: list[int]) -> float:
        own = np.searchsorted(np.array(sorted(cuts)), np.arange(n), "right")
        x = np.stack([np.ones(len(i)), (own[i] != own[j]).astype(float)], 1)
        return float(((x @ np.linalg.lstsq(x, e[i, j], rcond=None)[0] - e[i, j]) ** 2).sum())

    cuts, out = [], [[]]
    for _ in range(most - 1):
        left = [b for b in range(1, n) if b not in cuts]
        if not left:
            break
        cuts.append(min(left, key=lambda b: (round(error([*cuts, b]), 10), b)))
        out.append(sorted(cuts))
    return out


def distances(n: int, kind: str, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    where = {"steps": (np.arange(n) >= n // 2) * 1.0, "line": np.arange(n) * 3.0 / n, "none": rng.normal(size=n)}[kind]
    e = np.abs(where[:, None] - where[None, :]) + rng.normal(size=(n, n)) * 0.05
    return np.triu(e, 1) + np.triu(e, 1).T


@pytest.mark.parametrize("kind", ["steps", "line", "none"])
def test_cuts_against_least_squares(kind):
    for seed in range(4):
        e = distances(12 + seed, kind, seed)
        assert cutting._cuts(e, 6) == brute_path(e, 6)
        cuts = cutting._cuts(e, 3)[2]
        own = np.searchsorted(cuts, np.arange(len(e)), "right")
        i, j = np.triu_indices(len(e), 1)
        a, b = cutting._block_means(e, cuts)
        assert a == pytest.approx(e[i, j][own[i] == own[j]].mean()) and b == pytest.approx(e[i, j][own[i] != own[j]].mean())


def test_steps_and_slopes_are_told_apart(spark):
    rows = [(kind, 0, i, j, float(e[i, j])) for kind in ("steps", "line") for e in [distances(30, kind, 1)] for i in range(30) for j in range(i + 1, 30)]
    rows += [("few", 0, 0, 1, 0.5)]
    got = {r.lang: r for r in cutting.drift_segmentation(spark.createDataFrame(rows, "lang string, run bigint, i bigint, j bigint, x double")).collect()}
    assert set(got) == {"steps", "line"}
    assert got["steps"].shape < 0.7 < 1.2 < got["line"].shape
    assert "15" in got["steps"].cuts.split(",") and got["steps"].pages == 30


def test_the_fit_is_the_best_of_the_grid(spark):
    types = [("x", w, n) for w, n in (("banana", 5), ("bandana", 3), ("nab", 9), ("a", 4), ("abba", 2), ("dab", 7))] + [("y", "été", 2), ("y", "tête", 3)]
    ty = spark.createDataFrame(types, "lang string, tok string, n bigint")
    grid = list(itertools.product(searching.GRIDS["least"], searching.GRIDS["kinds"]))
    got = {(r.lang, r.least, r.kinds): r.loss for r in searching.cut_losses(ty, spark.createDataFrame([(g, a, b) for g in "xy" for a, b in grid], "lang string, least int, kinds int")).collect()}
    for lang in "xy":
        letters: dict[str, int] = {}
        for g, w, n in types:
            for c in w if g == lang else "":
                letters[c] = letters.get(c, 0) + n
        frequent = sorted(letters, key=lambda c: (-letters[c], c))
        for least, kinds in grid:
            pieces: dict[str, int] = {}
            for g, w, n in types:
                piece = ""
                for c in w if g == lang else "":
                    piece += c
                    if c in frequent[:kinds] and len(piece) >= least:
                        pieces[piece], piece = pieces.get(piece, 0) + n, ""
                if piece:
                    pieces[piece] = pieces.get(piece, 0) + n
            total = sum(pieces.values())
            loss = ((sum(len(p) * n for p, n in pieces.items()) / total - 3) / 3) ** 2 + ((len(pieces) / total - 0.05) / 0.05) ** 2
            assert got[lang, least, kinds] == pytest.approx(loss, abs=1e-8)
    for r in searching.grid_fit(ty).collect():
        assert r.loss == pytest.approx(min(v for k, v in got.items() if k[0] == r.lang), abs=1e-6)


def test_mantel_in_strata(spark):
    """rho and p against all deals inside strata."""
    rng = np.random.default_rng(3)
    a, b, strata = rng.normal(size=7), rng.normal(size=7), [0, 0, 0, 1, 1, 1, 1]
    b += a
    x, y = (np.abs(v[:, None] - v[None, :]) for v in (a, b))
    i, j = np.triu_indices(7, 1)
    keep = j - i >= 2
    rank = lambda v: np.array([np.sum(v < t) + (np.sum(v == t) - 1) / 2 for t in v])
    rx, full = rank(x[i, j]), np.zeros((7, 7))
    full[i, j] = full[j, i] = rank(y[i, j])
    rho = lambda o: np.corrcoef(rx[keep], full[np.array(o)[i], np.array(o)[j]][keep])[0, 1]
    every = [rho([*p, *q]) for p in itertools.permutations(range(3)) for q in itertools.permutations(range(3, 7))]
    pairs = spark.createDataFrame([("g", int(s), int(t), float(x[s, t]), float(y[s, t]), bool(t - s >= 2)) for s, t in zip(i, j)], "grp string, i bigint, j bigint, x double, y double, keep boolean")
    places = spark.createDataFrame([("g", k, s) for k, s in enumerate(strata)], "grp string, i bigint, stratum int")
    got = searching.stratified_mantel(pairs, places, 2000).first()
    assert (got.pages, got.pairs) == (7, int(keep.sum()))
    assert got.rho == pytest.approx(rho(range(7)), abs=1e-6)
    assert got.p == pytest.approx(np.mean([v >= rho(range(7)) - 1e-12 for v in every]), abs=0.03)


def test_substitutions_are_found(spark):
    """A short search does better on the cipher than on its control, and the same again."""
    r = random.Random(5)
    words = ["the", "theme", "then", "hen", "meet", "tent", "net", "he", "them", "teeth", "nth", "men"]
    rows = [("x", doc, n, p, r.choice(words)) for doc in range(12) for n in range(8) for p in range(9)]
    tk = spark.createDataFrame(rows, "lang string, doc_id bigint, line_no int, pos int, tok string")
    got = {x.condition: x for x in searching.substitution_search(tk, restarts=2, steps=1500, units=8).collect()}
    assert got["homophonic"].found >= 0.6 and got["homophonic"].bits < got["shuffled"].bits
    assert {x.condition: x for x in searching.substitution_search(tk, restarts=2, steps=1500, units=8).collect()} == got


def test_kept_relations_stay(spark, sf):
    """Plans that read a kept relation leave it in the cache."""
    from glyphmill.operators import run_tables

    run_tables(spark, sf, "token_stats").collect()
    kept = corpus.frames(spark, sf, ("tk",))["tk"]
    run_tables(spark, sf, "immediate_repeats").collect()
    assert kept.storageLevel.useMemory
    plan = corpus.query(spark, "select count(*) from {tk}", {"tk": kept})._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
