"""Plans against values worked out by hand on tiny corpora."""

from __future__ import annotations

import math

import pytest

from glyphmill.operators import run


def tokens(spark, pages: list[list[str]], lang: str = "xx"):
    """pages of lines of words."""
    out = [(d, lang, "s", i, len(line.split()), j, w) for d, page in enumerate(pages) for i, line in enumerate(page) for j, w in enumerate(line.split())]
    return spark.createDataFrame(out, "doc_id bigint, lang string, source string, line_no int, n_line bigint, pos int, tok string")


def pairs(spark, words: list[tuple[str, str]]):
    return spark.createDataFrame([(0, "xx", "s", i, 0, a, b) for i, (a, b) in enumerate(words)], "doc_id bigint, lang string, source string, line_no int, pos int, a string, b string")


def test_boundary_mi_of_a_copying_text(spark):
    got = run("boundary_mi", pr=pairs(spark, [("xa", "ay"), ("xb", "by")] * 4)).first()
    assert (got.n, got.mi) == (8, 1.0)


def test_boundary_mi_of_independent_letters(spark):
    got = run("boundary_mi", pr=pairs(spark, [("xa", "ay"), ("xa", "by"), ("xb", "ay"), ("xb", "by")])).first()
    assert got.mi == 0.0


def test_lag_profile_of_a_period(spark):
    line = " ".join(f"w{'abcde'[i % 5]}" for i in range(40))
    got = {r.k: r for r in run("t4a_lag_profile", tk=tokens(spark, [[line]])).collect()}
    assert got[5].peak and got[5].ratio > 4 and all(got[k].ratio == 0 for k in (2, 3, 4, 6, 7, 8))


def test_entropy_of_words(spark):
    got = run("token_stats", tk=tokens(spark, [["a a b c"]])).first()
    assert (got.tokens, got.types, got.hapax) == (4, 3, round(2 / 3, 6))
    assert got.entropy == 1.5


def test_jackknife_of_equal_groups_has_no_error(spark):
    t = tokens(spark, [["aa bb"], ["aa bb"]]).selectExpr("doc_id", "lang", "concat('s', doc_id) as source", "line_no", "n_line", "pos", "tok")
    got = run("jackknife", tk=t).first()
    assert (got.estimate, got.se) == (0.5, 0.0)


def test_repeats(spark):
    got = run("immediate_repeats", tk=tokens(spark, [["abc abc abc d d"]])).first()
    assert (got.pairs, got.triples, got.tokens) == (2.0, 1.0, 5)


def test_edit_pairs_have_no_doubles(spark):
    from glyphmill.functions.dialect import SPARK
    from glyphmill.sources.corpus import DEFINITIONS

    types = ["aab", "ab", "abb", "cab", "xyz"]
    t = spark.createDataFrame([(x, 9) for x in types], "tok string, n bigint")
    got = [(r.a, r.b) for r in spark.sql(DEFINITIONS["ed1"](SPARK), types=t).collect()]

    def near(a: str, b: str) -> bool:
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1] == 1

    assert sorted(got) == sorted((a, b) for a in types for b in types if near(a, b))


def test_fisher_on_a_known_table(spark):
    # the lady tasting tea: 3 of 4 right
    cells = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 3
    got = run("fisher_exact", labels=spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(cells)], "doc_id bigint, quality int, toxic int")).first()
    assert got.p == pytest.approx(34 / 70, abs=1e-6)


def test_binomial_on_a_known_case(spark):
    rows = [(i, 0, "user" if i < 3 else "assistant", "x") for i in range(9)]
    got = {r.role: r.p for r in run("binomial_test", conversations=spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    prob = [math.comb(9, j) * (1 / 3) ** j * (2 / 3) ** (9 - j) for j in range(10)]
    assert got["user"] == pytest.approx(1.0, abs=1e-6)
    assert got["assistant"] == pytest.approx(sum(p for p in prob if p <= prob[6] * (1 + 1e-7)), abs=1e-6)
