"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

Documents of a source fall into blocks by a hash of their id, which permutes them without a sort. A source's target is
reached by whole passes over its blocks, then blocks in order, then documents of one last block, in hash order, each
that still fits; the smallest left over joins them if that comes nearer. The block units of all sources form an urn. A
binary tree over the output shards draws, at every node, how many units of each source go left, so that every shard has
its share of the whole, every source spends exactly its quota, and the mix inside shards varies as under a random
shuffle. Units are dealt in order to the leaves: disjoint runs of permuted blocks. A document finds its copies' shards
by two joins: with one record of its source, and with the few leaves that share its run of RUN blocks. Both are tables;
Spark broadcasts them while they are small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.scratch import cut

#: Documents in a block on average; a parameter of plan_sources().
BLOCK_DOCS = 256
#: Blocks of a source whose leaves are looked up together, and blocks whose words are summed together.
RUN, SUPER = 64, 4096
#: No document is taken more often.
MAX_COPIES = 3
#: Words in a shard on average, from which the number of shards follows.
SHARD_WORDS = 16 << 20
#: Partitions that the mix is dealt to, for each core at least: shards are cut into pieces of their order.
PIECES_A_CORE = 4
WORD = r"[^\x20\x09-\x0D]+"


def _lnf(x: str) -> str:
    """SQL for ln(x!) but for a constant, by Stirling's series from x + 9 on."""
    factors = "*".join(f"({x}+{i}D)" for i in range(1, 9))
    return f"(({x}+8.5D)*ln({x}+9D)-({x}+9D)+1D/(12D*({x}+9D))-1D/(360D*power({x}+9D,3))-ln({factors}))"


def _log_weight(k: str, n: str, total: str, drawn: str) -> str:
    return f"(-{_lnf(f'({k})')}-{_lnf(f'({n}-{k})')}-{_lnf(f'({drawn}-{k})')}-{_lnf(f'({total}-{n}-{drawn}+{k})')})"


def hypergeometric(n: str, total: str, drawn: str, uniform: str) -> str:
    """SQL for how many of n marked among total are met in `drawn` draws: the value at `uniform` of the distribution.

    Weights are summed over 12 standard deviations to either side, cut at the possible values.
    """
    mean = f"(CAST({drawn} AS DOUBLE)*{n}/greatest({total},1))"
    reach = f"(12*sqrt({mean}*(1-CAST({n} AS DOUBLE)/greatest({total},1))+0.25D)+2)"
    low = f"greatest(0,{drawn}-({total}-{n}),CAST(floor({mean}-{reach}) AS BIGINT))"
    high = f"least({n},{drawn},CAST(ceil({mean}+{reach}) AS BIGINT))"
    mode = f"least(greatest(CAST(floor((CAST({n} AS DOUBLE)+1)*({drawn}+1)/({total}+2)) AS BIGINT),0,{drawn}-({total}-{n})),{n},{drawn})"
    weights = f"transform(array({_log_weight(mode, n, total, drawn)}), top -> transform(sequence({low},{high}), k -> named_struct('k',k,'w',exp({_log_weight('k', n, total, drawn)}-top))))[0]"
    scan = "aggregate(ws, named_struct('c',0D,'k',ws[0].k), (a,x) -> if(a.c < goal, named_struct('c',a.c+x.w,'k',x.k), a)).k"
    return f"transform(array({weights}), ws -> transform(array(({uniform})*aggregate(ws,0D,(a,x)->a+x.w)), goal -> {scan})[0])[0]"


def _uniform(*parts: str) -> str:
    return f"(pmod(xxhash64({','.join(parts)}),9007199254740992)/9007199254740992D)"


def _split(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """Each node becomes two. urn: for every source its rank r and its number n of block units."""
    draw = hypergeometric("x.n", "a.total", "a.drawn", _uniform(str(seed), str(level), "node", "x.r"))
    step = f"transform(array({draw}), k -> named_struct('total',a.total-x.n,'drawn',a.drawn-k,'out',concat(a.out,array(k))))[0]"
    start = "named_struct('total',aggregate(urn,0L,(s,x)->s+x.n),'drawn',aggregate(urn,0L,(s,x)->s+x.n) div 2,'out',cast(array() as array<bigint>))"
    left = nodes.withColumn("left", F.expr(f"aggregate(urn, {start}, (a,x) -> {step}, a -> a.out)"))
    children = F.expr("array(named_struct('node',node*2,'urn',transform(urn,(x,i)->named_struct('r',x.r,'n',left[i]))),named_struct('node',node*2+1,'urn',transform(urn,(x,i)->named_struct('r',x.r,'n',x.n-left[i]))))")
    return left.select(F.explode(children).alias("c")).select("c.node", "c.urn")


def _key(id_col: str, seed: int) -> tuple[Column, Column]:
    """Two independent hashes of an id: for its block, and for its place."""
    text = F.col(id_col).cast("string")
    return F.xxhash64(F.lit(seed), text), F.xxhash64(text, F.lit(seed + 1))


def plan_sources(sizes: DataFrame, seed: int = 7, block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """From rows (id, source, size): one row per source with all that decides on its documents; the leaves (rank, run,
    places) that each run of blocks meets; and the number of shards.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Their targets share the sum of all sizes by weight; none
    exceeds MAX_COPIES times its source's size, and what that leaves is shared again by weight: water filling, solved
    in one sweep over the sources in the order in which they fill up.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.select("*", (F.row_number().over(everything) - 1).alias("rank")).withColumn("weight", F.col("rank") % 3 + 1)
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * MAX_COPIES
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.select("*", level.alias("level"), total.alias("total"), F.row_number().over(filling).alias("turn"))
    # the first source that its level doesn't fill up: from it on, the level holds for all
    reached = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct("turn", "level"))).over(Window.partitionBy())["level"]
    sources = sources.withColumn("target", F.when(F.col("total") > 0, F.least(cap.cast("double"), F.col("weight") * reached)).otherwise(F.lit(0.0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-12)).otherwise(F.lit(0)).cast("bigint")
    sources = sources.select("*", passes.alias("passes"), F.ceil(F.col("n_docs") / block_docs).alias("n_blocks"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    sources = cut(sources.withColumn("rest", F.when(rest >= 0.5, rest).otherwise(F.lit(0.0))), "mix-sources")  # sizes are whole numbers

    block, place = _key("id", seed)
    per_source = sources.select(F.col("source").alias("s"), "n_blocks", "rest")
    rows = sizes.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "rest", F.pmod(block, "n_blocks").alias("block"), place.alias("place"))
    blocks = rows.groupBy("source", "block", "rest").agg(F.sum("size").alias("words"))
    blocks = cut(blocks, "mix-blocks")
    # the run of blocks in which a source's words pass its rest, then the block
    ordered = Window.partitionBy("source").orderBy("super")
    supers = blocks.groupBy("source", "rest", F.floor(F.col("block") / SUPER).alias("super")).agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(ordered))
    passing = supers.where("rest > 0 and upto > rest").groupBy("source").agg(F.min("super").alias("super"), F.min_by(F.col("upto") - F.col("words"), "super").alias("before"))
    within = blocks.join(passing.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("block") / SUPER) == F.col("super")))
    within = within.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("block")))
    last = within.where("upto > rest").groupBy("source").agg(F.min("block").alias("cut_block"), F.min_by(F.col("upto") - F.col("words"), "block").alias("base"))
    last = last.select(F.col("source").alias("s"), "cut_block", "base")
    inside = rows.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("cut_block")))
    # rows of one id are decided together; so a block's list is bounded by its ids
    places = inside.groupBy("source", "cut_block", "place", F.floor(F.col("rest") - F.col("base")).alias("room")).agg(F.sum("size").alias("size"))
    listed = places.groupBy("source", "cut_block", "room").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("block"))
    take = F.expr("""aggregate(block,
        named_struct('room', room, 'out', cast(array() as array<bigint>), 'least', cast(null as struct<size: bigint, place: bigint>)),
        (a, x) -> if(x.size <= a.room,
            named_struct('room', a.room - x.size, 'out', concat(a.out, array(x.place)), 'least', a.least),
            named_struct('room', a.room, 'out', a.out, 'least', if(a.least.size <= x.size, a.least, named_struct('size', x.size, 'place', x.place)))),
        a -> if(2 * a.room > a.least.size, concat(a.out, array(a.least.place)), a.out))""")
    picked = listed.select(F.col("source").alias("s"), "cut_block", take.alias("picks"))
    sources = sources.join(picked, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # with no last block, all or no blocks are taken once more
    sources = sources.withColumn("picks", F.coalesce("picks", F.array().cast("array<bigint>")))
    sources = sources.withColumn("cut_block", F.coalesce("cut_block", F.when(F.col("rest") > 0, F.col("n_blocks")).otherwise(F.lit(0))))
    sources = sources.withColumn("units", F.col("passes") * F.col("n_blocks") + F.least(F.col("n_blocks"), F.col("cut_block") + (F.size("picks") > 0).cast("bigint")))
    sources = cut(sources, "mix-quotas")

    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    depth = max(2, math.ceil(math.log2(max(1, words / shard_words))))
    nodes = sources.agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), F.col("units").alias("n")))).alias("urn")).select(F.lit(0).cast("bigint").alias("node"), "urn")
    for level in range(depth):
        nodes = cut(_split(nodes, level, seed), "mix-tree")
    leaves = nodes.select("node", F.explode("urn").alias("x")).select("node", F.col("x.r").alias("rank"), F.col("x.n").alias("n")).where("n > 0")
    leaves = leaves.withColumn("high", F.sum("n").over(Window.partitionBy("rank").orderBy("node"))).withColumn("low", F.expr("high - n"))
    # a leaf's units by the copy and the run of blocks that they are of
    leaves = leaves.join(sources.select(F.col("rank").alias("k"), "n_blocks"), F.col("rank") == F.col("k")).select("*", F.explode(F.expr("sequence(low div n_blocks, (high - 1) div n_blocks)")).alias("copy"))
    leaves = leaves.withColumn("first", F.expr("greatest(low - copy * n_blocks, 0)")).withColumn("end", F.expr("least(high - copy * n_blocks, n_blocks)"))
    leaves = leaves.select("rank", "copy", "end", "node", F.explode(F.expr(f"sequence(first div {RUN}, (end - 1) div {RUN})")).alias("run"))
    leaves = cut(leaves.groupBy("rank", "run").agg(F.array_sort(F.collect_list(F.struct("copy", "end", "node"))).alias("places")), "mix-leaves")
    return sources.drop("level", "total", "weight", "turn"), leaves, 1 << depth


def assign(rows: DataFrame, plan: DataFrame, leaves: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 7) -> DataFrame:
    """rows with copies (how often each is taken) and shards (the output shard of each copy), from what plan_sources() gives."""
    names = ["rank", "n_blocks", "passes", "cut_block", "picks"]
    small = plan.select(F.col("source").alias("_s"), F.struct(*names).alias("_p"), F.struct("source_size", "target").alias("mix"))
    block, place = _key(id_col, seed)
    joined = rows.join(small, F.col(source_col).eqNullSafe(F.col("_s"))).withColumn("_b", F.pmod(block, F.col("_p.n_blocks"))).withColumn("_at", place)
    once_more = (F.col("_b") < F.col("_p.cut_block")) | ((F.col("_b") == F.col("_p.cut_block")) & F.array_contains("_p.picks", F.col("_at")))
    joined = joined.withColumn("copies", F.col("_p.passes") + once_more.cast("bigint"))
    near = leaves.select(F.col("rank").alias("_r"), F.col("run").alias("_run"), "places")
    joined = joined.join(near, (F.col("_p.rank") == F.col("_r")) & (F.expr(f"_b div {RUN}") == F.col("_run")), "left")
    shards = F.expr("if(copies = 0, cast(array() as array<int>), transform(sequence(0L, copies - 1), c -> cast(filter(places, p -> p.copy = c and p.end > _b)[0].node as int)))")
    return joined.withColumn("shards", shards).drop("_s", "_p", "_b", "_at", "_r", "_run", "places")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """How each document takes part in the mix.

    One row per row of docs: id, source, size in words (null or empty text: 0), copies (0 to MAX_COPIES), shards, and
    mix with source_size and target. Null is a source of its own. Sources without words have target 0, and their
    documents are not taken. Rows with equal ids share a block and a place and are taken alike. Reruns agree, as all
    draws follow from ids and seed. An empty table gives no rows. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    plan, leaves, _ = plan_sources(sizes, seed)
    return assign(sizes, plan, leaves, "id", "source", seed).withColumnRenamed("id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs, with their columns, as often as they are taken, shard by shard in shuffled order.

    A shard's order is cut into pieces, each a partition of its own, so that there is work for every core; read in
    order of partitions the rows are the same whatever the number of pieces.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    plan, leaves, n_shards = plan_sources(sizes, seed)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    taken = assign(held, plan, leaves, "id", "source", seed).select("row", "id", F.posexplode("shards").alias("copy", "shard"))
    pieces = -(-PIECES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism // n_shards)
    order = F.xxhash64(F.lit(seed + 2), F.col("id").cast("string"), F.col("copy"))
    # the order's highest 20 bits, from the lowest value on
    part = F.expr(f"cast(shard * {pieces} + ((shiftright(`order`, 44) + 524288) * {pieces} div 1048576) as int)")
    return taken.withColumn("order", order).repartitionById(n_shards * pieces, part).sortWithinPartitions("shard", "order").select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    plan = mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("copies")).alias("taken"), "shards")
