"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.scratch import cut, drop

#: Edges that a task writes after a round; the number of files follows from that of the edges.
EDGES_A_FILE = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge to another: the smallest node reachable. edges: (a, b), any order.

    Alternates two steps until nothing changes: each node ties its larger neighbours to the smallest of its
    neighbourhood, then its smaller ones. Distances shrink geometrically and the edges never outnumber those given.
    Minima are combined before the shuffle and joined back, so a node with very many edges needs no task of its own.
    Null ends and loops are left out; repeated edges count once; no edges give an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    stars = cut(pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if state == before or not state[0]:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before, old, parts = state, stars, 1 + state[0] // EDGES_A_FILE
        both = stars.union(stars.select("hi", "lo")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, F.col("u") == F.col("k")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest.withColumnRenamed("hi", "k"), F.col("hi") == F.col("k")).where("lo <> m").select("m", "lo")
        stars = cut(moved.union(lowest.select("m", "hi")).toDF("lo", "hi").distinct().coalesce(parts), "edges")
        drop(old)
