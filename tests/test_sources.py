"""Readers and sinks on small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.sources import results
from glyphmill.sources import transliteration as t

MARKED = """# a comment

<p1a>      <! $Q=A $I=T $L=A $H=1>
<p1a.1,@P0>       mirel.osta.ar<!here>[a:o]tin,selo<->@152;or.{c'y}dun!
<p1a.2,+P0>       vory.quar<$>
<p1b>      <! $Q=A $L=B>
<p1b.1,@P0>       o?r.y
"""


def test_transliteration(spark, tmp_path):
    (tmp_path / "a.txt").write_text(MARKED)
    got = t.read_transliteration(spark, str(tmp_path / "a.txt")).orderBy("at").collect()
    assert [(r.page, r.num, r.locus) for r in got] == [("p1a", 1, "@P0"), ("p1a", 2, "+P0"), ("p1b", 1, "@P0")]
    assert got[0].words == ["mirel", "osta", "aratin", "selo", "*or", "dun"]
    assert got[0].meta == {"Q": "A", "I": "T", "L": "A", "H": "1"} and got[2].meta["L"] == "B"
    assert [r.para_final for r in got] == [False, True, False]
    assert [r.eligible for r in got] == [False, True, False]


def test_gaps_and_commas(spark, tmp_path):
    (tmp_path / "b.txt").write_text("<p1> <! $B=1 $Q=C>\n<p1.1,@P0> a,b<~>c\n<p1.2,@P0> a<->b\n")
    rows = t.read_transliteration(spark, str(tmp_path / "b.txt"), gaps="-", commas_part=False).orderBy("num").collect()
    assert [(r.words, r.eligible, r.meta["B"]) for r in rows] == [(["ab", "c"], True, "1"), (["a", "b"], False, "1")]
    assert [r.eligible for r in t.read_transliteration(spark, str(tmp_path / "b.txt")).collect()] == [False, False]


def test_pages_of_verse(spark):
    df = t.verse_pages(spark.range(45).toDF("k"), "k")
    assert [tuple(r) for r in df.where("k in (0, 19, 20, 44)").orderBy("k").collect()] == [(0, 0, 0), (19, 0, 19), (20, 1, 0), (44, 2, 4)]


def test_words_of_books_and_scripts(spark):
    df = spark.createDataFrame([("b", "x\n*** START OF IT ***\nOne, été 2\n*** END OF IT ***\ny")], "book string, value string")
    assert [tuple(r) for r in t.book_words(df).orderBy("pos").collect()] == [("b", 0, "one"), ("b", 1, "été")]
    hebrew = spark.createDataFrame([("abc שלום, עולם",)], "s string")
    assert hebrew.select(t.range_words(F.col("s"), "א", "ת")).first()[0] == ["שלום", "עולם"]


def test_logs_become_rows(spark, tmp_path):
    (tmp_path / "a.log").write_text("mi = 0.25 bits\nnothing\nmi = 1e-3 bits, se=2\n")
    got = results.read_logs(spark, str(tmp_path / "a.log"), {"mi": r"mi = (\S+)", "se": r"se=(\d+)"})
    assert sorted(tuple(r) for r in got.collect()) == [("a.log", "mi", 0.001), ("a.log", "mi", 0.25), ("a.log", "se", 2.0)]


def test_aligned_readings(spark):
    lines = lambda rows: spark.createDataFrame(rows, "page string, num int, words array<string>")
    got = t.align_readings(lines([("p", 1, ["a", "b"]), ("p", 2, ["c"]), ("p", 3, ["d?"])]), lines([("p", 1, ["a", "x"]), ("p", 2, ["c", "d"]), ("p", 3, ["d?"])])).orderBy("num").collect()
    assert [r.dc for r in got] == [[True, False], None, [False]]


def test_handwriting(spark, tmp_path):
    (tmp_path / "w.txt").write_text("- Foo bar-\nBaz\n\n___\nqux 1\n")
    got = t.read_handwriting(spark, str(tmp_path / "*.txt")).orderBy("line_no").collect()
    assert [(r.words, r.para_final, r.hyph) for r in got] == [(["foo", "bar"], False, True), (["baz"], True, False), (["qux"], False, False)] or got[2].words == ["qux"]


def test_book_body(spark):
    df = spark.createDataFrame([("x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny",), ("plain",)], "text string")
    assert [r[0].strip() for r in df.select(t.book_body(F.col("text"))).collect()] == ["body", "plain"]


def test_code_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿code,glyphs\none_a,ol\n", encoding="utf-8")
    assert [tuple(r) for r in t.read_code_table(spark, str(tmp_path / "c.csv")).collect()] == [("one_a", "ol")]


def test_results_are_taken_up(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    path = str(tmp_path / "r")
    results.append_new(df.where("k = 'a'"), path, ["k"])
    results.append_new(df, path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_json_and_print(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"c": {"t": {"x": 1.5}}}')
    got = results.read_json_results(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in got.collect()] == [("c", "t", "x", 1.5)]
    assert results.fixed_width(got, {"stat": 4, "value": 7}).first().line == "   x   1.500"
