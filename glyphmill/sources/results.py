"""Tidy results: written as they come, taken up where they ended, and printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(results: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows of results whose keys aren't under path yet, and return those."""
    spark = results.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = results.select(*keys).limit(0)
    new = results.join(done, keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def read_json_results(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, test, stat, value) of nested JSON results {corpus: {test: {stat: number}}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, map<string, double>>>").alias("m"))
    first = whole.select(F.explode("m").alias("corpus", "tests"))
    second = first.select("corpus", F.explode("tests").alias("test", "stats"))
    return second.select("corpus", "test", F.explode("stats").alias("stat", "value"))


def read_logs(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(file, stat, value) of text logs: each pattern's first group, as a number, wherever it's met in a line."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"[^/]*$", 0).alias("file"), "value")
    found = F.array(*[F.struct(F.lit(name).alias("stat"), F.regexp_extract_all("value", F.lit(p), F.lit(1)).alias("values")) for name, p in patterns.items()])
    each = lines.select("file", F.explode(found).alias("f")).select("file", "f.stat", F.explode("f.values").alias("value"))
    return each.select("file", "stat", F.expr("try_cast(value as double)").alias("value"))


def fixed_width(df: DataFrame, widths: dict[str, int], decimals: int = 3) -> DataFrame:
    """One text column of the named columns, each right in its width."""
    kinds = dict(df.dtypes)

    def cell(name: str, width: int) -> Column:
        text = F.format_string(f"%.{decimals}f", F.col(name)) if kinds[name] in ("double", "float") else F.col(name).cast("string")
        return F.lpad(F.coalesce(text, F.lit("-")), width, " ")

    return df.select(F.concat_ws(" ", *[cell(n, w) for n, w in widths.items()]).alias("line"))
