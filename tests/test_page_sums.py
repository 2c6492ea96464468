"""Plans whose tasks return sums of whole pages: no row for a word, and the rows of the SQL for odd pages and for the tables."""

from __future__ import annotations

import random

import pytest

from glyphmill import plans
from glyphmill.operators import run_tables
from tests.compare import rows
from tests.test_pages import PAGES, theirs

plans.load()
NAMES = ["e1_graded", "t1_line_break", "page_cosine", "space_gain", "t2a_difference", "window_percentiles", "poured_text", "pmi_by_edit_distance", "collocations", "page_mi", "leave_one_out_radius", "t7a_edits"]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd pages, and drawn ones of few words in short and empty lines."""
    r = random.Random(3)
    words = ["a", "the", "été", "mill", "mills", "stream", "x", "no", "of", "on", "çà", "thunderstorm"]
    drawn = [(1000 + 37 * k, "\n".join(" ".join(r.choices(words, weights=range(12, 0, -1), k=r.choice([0, 1, 2, 5, 9]))) for _ in range(r.choice([1, 6, 30, 90]))), r.choice(["en", "fr", "de", None]), r.choice(["a", "b", "c", None])) for k in range(60)]
    top = tmp_path_factory.mktemp("sums")
    spark.createDataFrame(PAGES + drawn, SCHEMA).repartition(3).write.parquet(f"{top}/alone/documents.parquet")
    spark.createDataFrame([*PAGES, (8, "a b", "fr", None)], SCHEMA).coalesce(1).write.parquet(f"{top}/twice/documents.parquet")
    return top


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_odd_pages(spark, odd, name):
    found = run_tables(spark, str(odd / "alone"), name)
    plan = found._jdf.queryExecution().toString()
    assert ("MapInArrow" in plan or "ExistingRDD" in plan or "FlatMapGroupsInArrow" in plan) and "posexplode" not in plan and "InMemoryRelation" not in plan
    assert rows(found.toPandas()) == rows(theirs(odd / "alone", name))


@pytest.mark.parametrize("name", NAMES)
def test_pages_of_one_id(spark, odd, name):
    plan = run_tables(spark, str(odd / "twice"), name)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("name", sorted({*NAMES} & {*plans.PLANS}))
def test_rows_of_tables(spark, duck, sf, name):
    assert rows(run_tables(spark, sf, name).toPandas()) == rows(duck.sql(plans.duck_text(name)).df())


@pytest.mark.parametrize("sizes", [(3, 2, 4), (1024, 256, 2048)])
def test_cosines_of_blocks(spark, tmp_path, monkeypatch, sizes):
    """Several blocks of a source, with few and with all words in tables, and strips that end anywhere."""
    from glyphmill.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 7)
    for name, size in zip(("FREQUENT", "ROWS", "COLUMNS"), sizes, strict=True):
        monkeypatch.setattr(pairs, name, size)
    monkeypatch.setattr(pairs, "PART", 2)
    r = random.Random(5)
    words = ["the", "of", "été", *(f"w{chr(97 + k)}" for k in range(20))]
    pages = [(k * 3 - 50, " ".join(r.choices(words, weights=[9, 6, 4] + [1] * 20, k=r.choice([1, 3, 9, 30]))), "en", r.choice(["a", "a", "b", None])) for k in range(70)]
    spark.createDataFrame(pages, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(run_tables(spark, str(tmp_path), "page_cosine").toPandas()) == rows(theirs(tmp_path, "page_cosine"))


def test_merges_in_passes(spark, monkeypatch):
    """Against merges one word at a time; no group holds all words."""
    from collections import Counter

    from glyphmill.operators import searching

    r = random.Random(8)
    words = {"".join(r.choices("aab\u00e9", k=r.randint(1, 9))): r.randint(1, 5) for _ in range(60)} | {"aaaaa": 4, "x": 1}
    split, expected = {w: list(w) for w in words}, []
    for step in range(24):
        pairs, units = Counter(), Counter()
        for w, n in words.items():
            for p in zip(split[w], split[w][1:]):
                pairs[p] += n
            for u in split[w]:
                units[u] += n
        expected.append((step, len(units), round(sum(units.values()) / sum(words.values()), 6)))
        best = min(pairs, key=lambda p: (-pairs[p], p))
        for own in split.values():
            i = 0
            while i + 1 < len(own):
                if (own[i], own[i + 1]) == best:
                    own[i : i + 2] = ["".join(best)]
                i += 1
    monkeypatch.setattr(searching, "WRITTEN", 5)
    found = searching.bpe_curve(spark.createDataFrame(list(words.items()), "tok string, n bigint").repartition(3), 23, 1)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert [(x.merges, x.units, x.units_per_word) for x in found.orderBy("merges").collect()] == expected
    assert searching.bpe_curve(spark.createDataFrame([], "tok string, n bigint")).count() == 0
