"""Marked-up transliterations, plain texts and dictionaries as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_words(raw: Column, commas_part: bool = True) -> Column:
    """Words of a line of markup: the first of alternatives, * for rare signs, no comments, no tags; gaps part words, and commas unless told otherwise."""
    t = F.regexp_replace(raw, r"\[([^:\]]*):[^\]]*\]", "$1")
    t = F.regexp_replace(t, r"@\d+;", "*")
    t = F.regexp_replace(t, r"<!.*?>", "")
    t = F.regexp_replace(t, r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"<[-~]>", ".")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.translate(F.regexp_replace(t, r"[!\s]", ""), ",", "." if commas_part else "")
    return F.filter(F.split(t, r"\."), lambda w: w != "")


def read_transliteration(spark: SparkSession, path: str, gaps: str = "-~", commas_part: bool = True) -> DataFrame:
    """(file, page, num, locus, raw, words, meta, para_final, eligible) of files of page headers and lines.

    A page header <page> <! $K=V ...> sets the metadata of the lines after it; lines are <page.num,locus> text. Comments (#) and
    blanks are passed over. Files are read whole, so that lines keep their order. Lines with an uncertain word or one of
    the gaps named (<-> and <~>) aren't eligible.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    files = files.where("trim(line) <> '' and not startswith(line, '#')")
    header = F.regexp_extract("line", r"^<([^.>,]+)>\s*(?:<!\s*(.*?)>)?\s*$", 1)
    pairs = F.regexp_extract_all("line", F.lit(r"\$(\w=\w+)"), F.lit(1))
    meta = F.when(header != "", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring(p, 1, 1), p.substr(F.lit(3), F.length(p))))))
    held = files.select("file", "at", "line", header.alias("header"), meta.alias("meta"))
    carried = held.withColumn("meta", F.last("meta", ignorenulls=True).over(Window.partitionBy("file").orderBy("at")))
    part = lambda k: F.regexp_extract("line", r"^<([^.>]+)\.(\d+)[a-z]?,([^>]*)>\s*(.*)$", k)
    lines = carried.where("header = ''").select("file", "at", part(1).alias("page"), part(2).alias("num"), part(3).alias("locus"), part(4).alias("raw"), "meta").where("page <> ''")
    words = clean_words(F.col("raw"), commas_part)
    certain = F.forall(words, lambda w: ~w.rlike(r"[?*]"))
    return lines.select("file", "at", "page", F.col("num").cast("int").alias("num"), "locus", "raw", words.alias("words"), "meta", F.col("raw").contains("<$>").alias("para_final"), (certain & ~F.col("raw").rlike(f"<[{gaps}]>")).alias("eligible"))


def align_readings(first: DataFrame, second: DataFrame) -> DataFrame:
    """first with dc, which of its words a second reading of the same lines has too; null where the second has no line or another number of words."""
    other = second.select(F.col("page").alias("_p"), F.col("num").alias("_n"), F.col("words").alias("_w"))
    joined = first.join(other, (F.col("page") == F.col("_p")) & (F.col("num") == F.col("_n")), "left")
    same = F.transform(F.arrays_zip("words", "_w"), lambda x: (x["words"] == x["_w"]) & ~x["words"].rlike(r"[?*]"))
    return joined.withColumn("dc", F.when(F.size("words") == F.size("_w"), same)).drop("_p", "_n", "_w")


def read_handwriting(spark: SparkSession, path: str) -> DataFrame:
    """(page, line_no, words, para_final, hyph) of plain texts, a file a page: ___ parts pages of a writer, blanks paragraphs, bullets go, a hyphen at the end is marked."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    own = files.where("trim(line) <> '___'").withColumn("line", F.trim("line"))
    after = own.withColumn("next", F.lead("line").over(Window.partitionBy("page").orderBy("at")))
    text = F.regexp_replace("line", r"^[-*]\s*", "")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    kept = after.where("line <> ''").select("page", "at", words.alias("words"), (F.col("next").isNull() | (F.col("next") == "")).alias("para_final"), F.col("line").endswith("-").alias("hyph"))
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy("page").orderBy("at")) - 1).drop("at")


def book_body(text: Column) -> Column:
    """A book's text between the lines that mark its start and end, or all of it."""
    body = F.regexp_extract(text, r"(?s)\*\*\* ?START OF[^\n]*\*\*\*(.*?)(?:\*\*\* ?END OF|\z)", 1)
    return F.when(body == "", text).otherwise(body)


def range_words(text: Column, low: str, high: str) -> Column:
    """Runs of the letters of a range, such as those of one script."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{low}-{high}]+"), F.lit(0))


def book_words(books: DataFrame, text: str = "value") -> DataFrame:
    """books with the words of each book's body, in order: pos and tok."""
    words = F.regexp_extract_all(F.lower(book_body(F.col(text))), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    return books.select(*[c for c in books.columns if c != text], F.posexplode(words).alias("pos", "tok"))


def verse_pages(lines: DataFrame, order: str, lines_a_page: int = 20) -> DataFrame:
    """Running lines as pages of so many: adds page and line_no from a column of places from 0."""
    return lines.withColumn("page", F.floor(F.col(order) / lines_a_page)).withColumn("line_no", F.col(order) % lines_a_page)


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """(code, glyphs) of a CSV file with a header; a byte order mark before it is passed over."""
    table = spark.read.option("header", True).csv(path)
    return table.toDF(*[c.lstrip("﻿") for c in table.columns])
