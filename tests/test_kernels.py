"""Kernels: what must hold of their results, and that reruns agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill.kernels import QUERIES
from glyphmill.operators.coding import Coder, replay
from glyphmill.operators.keyed import Draws
from tests.compare import rows

#: substitution_search takes minutes with its 40,000 steps; test_shape.py has a shorter one.
QUICK = sorted(set(QUERIES) - {"compressed_size", "substitution_search"})


@pytest.mark.parametrize("name", QUICK)
def test_reruns_agree(spark, sf, name):
    first = QUERIES[name](spark, sf).toPandas()
    assert len(first)
    assert rows(first) == rows(QUERIES[name](spark, sf).toPandas())


def test_messages_come_back(spark, sf):
    assert all(r.wrong == 0 for r in QUERIES["message_round_trip"](spark, sf).collect())


def test_markup_is_read_alike(spark, sf):
    for r in QUERIES["markup_edits"](spark, sf).collect():
        assert r.agree == 1.0 and r.changes == r.due


def test_text_keeps_its_layout(spark, sf):
    from glyphmill.sources.corpus import frames

    lines = frames(spark, sf, ("tk",))["tk"].select("doc_id", "line_no").distinct().count()
    assert QUERIES["copied_text"](spark, sf).count() == lines
    assert QUERIES["recency_text"](spark, sf).count() == lines


def test_coder_by_itself():
    d = Draws("t")
    for tables in (lambda done: [1, 1, 1], lambda done: [1, 97, 2] if len(done) % 2 else [5, 1]):
        bits = [int(d.uniform() < 0.5) for _ in range(200)]
        back = Coder.bits(Coder.choices(bits, tables, 100_000), tables)
        assert back[:200] == bits


def test_replay_places():
    assert replay("ab.c<!corrected>d.[e:f]<!erased>") == [(1, 1, "corrected"), (2, 1, "erased")]
    assert replay("a<->b<!nothing>") == []
    assert replay("ab,cd@138;e<!Corrected>") == [(0, 6, "Corrected")]
    assert replay("a. b c[@12;x:y]{z}!<!erased>..<~>d<!above") == [(1, 4, "erased"), (2, 1, "above")]


def test_draws_are_keyed():
    assert [Draws("a").uniform() for _ in range(2)] == [Draws("a").uniform()] * 2
    assert Draws("a").uniform() != Draws("b").uniform()
    assert sorted(Draws("c").shuffled(list(range(20)))) == list(range(20))


def test_matrix_goes_on(spark, sf, tmp_path):
    from glyphmill.operators import run_matrix

    def fails(spark, sf_dir):
        raise RuntimeError("no")

    got = {r.name: r for r in run_matrix(spark, sf, {"a": QUERIES["grid_fit"], "b": fails}, str(tmp_path)).collect()}
    assert got["a"].rows > 0 and got["a"].error is None and got["b"].error == "no"


def test_stages_wait_for_their_controls(spark, sf, tmp_path):
    from glyphmill.operators import run_stages

    def fails(spark, sf_dir):
        raise RuntimeError("no")

    ok = lambda spark, sf_dir: spark.range(3)
    got = run_stages(spark, sf, {"controls": {"a": ok}, "targets": {"b": ok, "c": fails}, "more": {"d": ok}}, str(tmp_path)).collect()
    assert [(r.stage, r.name, r.rows) for r in got] == [("controls", "a", 3), ("targets", "b", 3), ("targets", "c", None)]


def test_pages_are_wrapped_whole(spark, sf):
    from glyphmill.operators.generating import wrapped_text
    from glyphmill.sources.corpus import frames

    tk = frames(spark, sf, ("tk",))["tk"]
    got = wrapped_text(tk, width=20, lines=3)
    assert got.selectExpr("sum(size(split(text, ' ')))").first()[0] == tk.count()
    assert got.selectExpr("max(line_no)").first()[0] == 2


def test_line_ends_by_permutation(spark):
    from glyphmill.operators.searching import final_form

    rows = [("x", d, l, 6, p, ("ab" if p < 5 else "cd") + "efgh"[(d + l + p) % 4] * (p % 2) + ("s" if p == 5 else "te"[(d * 7 + l * 3 + p) % 2])) for d in range(30) for l in range(4) for p in range(6)]
    marked = spark.createDataFrame(rows, "lang string, doc_id bigint, line_no int, n_line bigint, pos int, tok string")
    got = {r.kind: r for r in final_form(marked).collect()}
    assert got["margin"].n_final == 90 and got["para"].n_final == 30
    assert all(r.excess > 0.3 and r.p < 0.01 for r in got.values())
    plain = marked.withColumn("tok", F.concat(F.lit("a"), F.substring("tok", 2, 1), F.expr("substr('te', 1 + cast(abs(hash(doc_id, line_no, pos)) % 2 as int), 1)")))
    assert all(abs(r.excess) < 0.1 and r.p > 0.01 for r in final_form(plain).collect())


def test_orders_are_found():
    import numpy as np

    from glyphmill.operators.searching import _insertions

    rng = np.random.default_rng(3)
    secret = rng.permutation(12)
    m = np.zeros((12, 12))
    for i in range(12):
        for j in range(i + 1, 12):
            m[secret[i], secret[j]] = rng.integers(1, 9)
    value, order = _insertions(m, np.arange(12))
    assert value == m.sum() and order.tolist() == secret.tolist()
