"""Every plan gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

import pytest

from glyphmill import plans
from glyphmill.operators import run_tables
from tests.compare import rows

plans.load()
#: Composites of plans that are tested by themselves.
SLOW = {"phenotype", "verdicts", "test_profile"}


@pytest.mark.parametrize("name", sorted(set(plans.PLANS) - SLOW))
def test_plan(spark, duck, sf, name):
    ours, theirs = run_tables(spark, sf, name).toPandas(), duck.sql(plans.duck_text(name)).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_types_are_whole(spark):
    """Long and rare words and ones with letters beyond a-z count in the queries over types."""
    from glyphmill.operators import run
    from glyphmill.operators.searching import bpe_curve
    from glyphmill.sources.corpus import DEFINITIONS, SPARK

    ty = spark.createDataFrame([("x", "été", 1), ("y", "été", 2), ("x", "thunderstorming", 1), ("x", "thundrstorming", 1), ("x", "the", 9)], "lang string, tok string, n bigint")
    types = spark.sql(DEFINITIONS["types"](SPARK), ty=ty)
    assert {r.unit: r.n for r in run("multigraph_units", types=types).collect()}["é"] == 6
    assert run("families", types=types).first().types == run("plain_alphabet", types=types).first().types == 4
    assert {r.s: r.n for r in run("common_suffixes", types=types).collect()} == {0: 1, 9: 1}
    assert sum(r.n for r in run("tall_letters", types=types).collect()) == 14
    assert "été" in {r.piece for r in run("rule_spaces", types=types).collect()}
    assert bpe_curve(types).orderBy("merges").first().units == len(set("ététhunderstormingthe"))
    for name in ("multigraph_units", "retokenised", "families", "consonant_skeletons", "syllables", "rule_spaces", "plain_alphabet", "tall_letters", "common_suffixes"):
        assert plans.PLANS[name][1] == ("types",)


def test_battery_is_tidy(spark, sf):
    got = run_tables(spark, sf, "battery")
    assert got.columns == ["lang", "stat", "value"]
    assert got.count() > 30


def test_missing_relation(spark):
    from glyphmill.operators import run

    with pytest.raises(ValueError, match="reads"):
        run("char_entropy", tk=spark.range(1))
