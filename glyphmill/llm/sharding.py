"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards while counts stay even.

Documents of one text are alike, so they go as one class: a row per text and shard counts how many of them are there.
They are each other's neighbours; further links may be given. A round joins classes with the counts of their neighbours,
each class picks the shard with most of them, and moves are granted by gain within quotas: what a shard has left, and
what two shards exchange. Rounds write small tables and send the driver sums by pair of shards alone. In the end every
document looks up its place: by its rank within its text, dealt in buckets, so a text of very many copies is no task of
its own. Documents over a shard's quota, taken from its largest text, and all that are linked with nothing fill the places that are left, so counts
differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.scratch import cut, drop

SHARDS = 40
#: Rounds at most. When rounds of each kind (to shards with room, to any, to a new one) move nothing, that ends it before.
ROUNDS = 64
#: Documents of one text whose shards are looked up together.
STEP = 1 << 12
#: Links of one text from which on they are dealt in parts.
HEAVY = 100_000


def _buckets(n: int) -> int:
    """Buckets that ranks are counted in: about as many as a bucket then has rows."""
    return max(1, math.isqrt(n))


def _ranks(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """rows, which have a num each, with their rank from 0 among those of one key and how many (total) these are."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), "num"), F.lit(_buckets(n))))
    sums = rows.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))  # a row per bucket
    sums = sums.withColumn("before", F.sum("c").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("c").over(own))
    at = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("num")) - 1
    return rows.withColumn("at", at).join(sums.drop("c"), [*key, "bucket"]).withColumn("rank", F.col("at") + F.coalesce("before", F.lit(0))).drop("at", "before", "bucket")


def _grants(asked: list, room: list[int]) -> list[tuple[int, int, int, int, float]]:
    """(from, to, level, n, share): how much of what is asked is granted, the highest gains first. asked: (from, to, level, n)."""
    total: dict[tuple[int, int], int] = {}
    for s, t, _, n in asked:
        total[s, t] = total.get((s, t), 0) + n
    left = {(s, t): min(n, total.get((t, s), 0)) for (s, t), n in total.items()}  # exchanges
    free, out = [max(0, r) for r in room], []
    for s, t, level, n in sorted(asked, key=lambda x: (-x[2], x[0], x[1])):
        swap = min(n, left[s, t])
        more = min(n - swap, free[t])
        left[s, t] -= swap
        free[t] -= more
        if swap + more:
            out.append((s, t, level, swap + more, (swap + more) / n))
    return out


def _neighbours(state: DataFrame, links: DataFrame | None) -> DataFrame:
    """(key, shard, w): how many documents linked with a text, its own among them, are in a shard."""
    own = state.select("key", "shard", F.col("n").alias("w"))
    if links is None:
        return own
    heavy = F.broadcast(links.where("parts > 1").select("other", "parts").distinct())  # HEAVY bounds them
    dealt = state.withColumnRenamed("key", "other").join(heavy, "other", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)))
    far = links.select("key", "other", "part", "w").join(dealt.select("other", "part", "shard", "n"), ["other", "part"])
    return own.union(far.select("key", "shard", F.col("w") * F.col("n"))).groupBy("key", "shard").agg(F.sum("w").alias("w"))


def _propagate(state: DataFrame, links: DataFrame | None, quota: list[int], rounds: int) -> DataFrame:
    """state: (key, shard, n), n documents of a text in a shard; links: (key, other, part, parts, w), pairs of texts both ways."""
    spark, idle, kinds = state.sparkSession, 0, 2 if links is not None else 3
    tie = F.xxhash64("key", "shard").alias("tie")
    for k in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        near = _neighbours(state, links)
        held = near.withColumn("n", F.col("w")) if links is None else state.join(near, ["key", "shard"])
        kind, roomy = k % kinds, [s for s, r in enumerate(room) if r > 0]
        if kind == 2:  # texts whose shards are all full meet in one that isn't
            best = near.groupBy("key").agg(F.count(F.lit(1)).alias("in"), F.max(F.col("shard").isin(roomy)).alias("open"), F.sum("w").alias("w")).where(~F.col("open") & (F.col("in") > 1) & (F.col("w") <= max(room)))
            meet = F.element_at(F.array(*map(F.lit, roomy or [0])), (F.pmod(F.xxhash64(F.lit(k), "key"), F.lit(max(1, len(roomy)))) + 1).cast("int"))
            best = best.select("key", F.struct("w", F.lit(0).cast("bigint").alias("tie"), meet.alias("shard")).alias("best"))
        else:
            best = (near if kind else near.where(F.col("shard").isin(roomy))).groupBy("key").agg(F.max(F.struct("w", tie, "shard")).alias("best"))
        stays = F.when(F.col("shard").isin(roomy) | (F.lit(kind) > 0), tie).otherwise(F.lit(-(1 << 63))).alias("tie")  # equals leave a full shard
        moving = held.join(best, "key").where((F.col("shard") != F.col("best.shard")) & (F.struct("w", stays) < F.struct(F.col("best.w").alias("w"), F.col("best.tie").alias("tie"))))
        if links is not None:  # neighbours that move at once could change places for ever
            moving = moving.where(F.pmod(F.xxhash64(F.lit(k), "key"), F.lit(2)) == 0)
        gain = F.col("best.w") - F.col("w") + 1
        moving = cut(moving.select("key", "shard", "n", F.col("best.shard").alias("to"), F.floor(F.log2(gain)).cast("int").alias("level")), "moves")
        granted = _grants([tuple(r) for r in moving.groupBy("shard", "to", "level").agg(F.sum("n")).collect()], room)  # by pair of shards and level
        moved = 0
        if granted:
            grants = F.broadcast(spark.createDataFrame(granted, "shard int, to int, level int, granted bigint, share double"))
            luck = F.pmod(F.xxhash64(F.lit(k), F.lit(0), "key"), F.lit(1 << 20)) / (1 << 20)
            # small classes go whole or not at all
            some = F.when(F.col("share") >= 1, F.col("n")).when(F.col("n") * 8 <= F.col("granted"), F.when(luck < F.col("share"), F.col("n")).otherwise(0)).otherwise(F.floor(F.col("n") * F.col("share")))
            moves = cut(moving.join(grants, ["shard", "to", "level"]).select("key", "shard", "to", some.cast("bigint").alias("n")).where("n > 0"), "granted-moves")
            moved = moves.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        idle = 0 if moved else idle + 1
        if idle == (3 if links is None else 4):
            break
        if moved:
            new = state.union(moves.select("key", "shard", -F.col("n"))).union(moves.select("key", "to", "n"))
            new = cut(new.groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "classes")
            drop(state, moves)
            state = new
        drop(moving)
    return state


def _trimmed(state: DataFrame, quota: list[int]) -> DataFrame:
    """state, with what a shard has over its quota taken from its largest text, which is the most likely to be cut anyway."""
    load = state.groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row per shard
    over = [(r["shard"], r["n"] - quota[r["shard"]]) for r in load if r["n"] > quota[r["shard"]]]
    if not over:
        return state
    over = F.broadcast(state.sparkSession.createDataFrame(over, "shard int, over bigint"))
    top = F.broadcast(state.join(over, "shard").groupBy("shard", "over").agg(F.max(F.struct("n", "key")).alias("top")).select("shard", F.col("top.key").alias("key"), "over"))
    return state.join(top, ["shard", "key"], "left").select("key", "shard", (F.col("n") - F.coalesce("over", F.lit(0))).alias("n")).where("n > 0")


def _text_links(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, other, part, parts, w): links between texts, both ways; those of a text with very many are dealt in parts."""
    ends = links.select("a", "b").where("a is not null and b is not null")
    ids = keyed.where("id is not null").select("id", "key").distinct()
    pairs = ends.join(ids.toDF("a", "key"), "a").join(ids.toDF("b", "other"), "b").where("key <> other").select("key", "other")
    pairs = cut(pairs.union(pairs.select("other", "key")).groupBy("key", "other").agg(F.count(F.lit(1)).alias("w")), "text-pairs")
    most = max(HEAVY, pairs.count() // 1000)  # so a thousand texts at most have more
    heavy = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).where("parts > 1")
    pairs = pairs.join(F.broadcast(heavy), "other", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut(pairs.withColumn("part", F.pmod(F.xxhash64("key"), "parts")), "text-links")


def _plan(docs: DataFrame, shards: int, links: DataFrame | None, id_col: str, text_col: str, rounds: int, whole: bool) -> DataFrame:
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_group"), F.monotonically_increasing_id().alias("num"), *([F.struct(*docs.columns).alias("row")] if whole else []),
    )
    rows = cut(rows, "shard-rows")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    # a null text is a class of its own
    keyed = rows.select("num", "id", F.coalesce("text_group", F.col("num").cast("string").cast("binary")).alias("key"))
    ranked = _ranks(keyed.select("num", "key"), ["key"], n)
    linked, pairs = ranked.where("total > 1"), None
    if links is not None:
        ranked, pairs = cut(ranked, "ranked-rows"), _text_links(keyed, links)
        linked = ranked.where("total > 1").union(ranked.where("total = 1").join(pairs.select("key").distinct(), "key", "left_semi").select(ranked.columns))
    linked = cut(linked, "linked-rows")
    start = F.pmod(F.xxhash64(F.lit(2), "num"), F.lit(shards)).cast("int")
    state = _propagate(cut(linked.groupBy("key", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "classes"), pairs, quota, rounds)
    state = _trimmed(state, quota)

    # ranks of a text from low on are in a shard; rows look up the step of ranks that theirs is in
    high = F.sum("n").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    runs = state.withColumn("high", high).withColumn("low", F.col("high") - F.col("n"))
    runs = runs.select("key", "shard", "low", "high", F.explode(F.sequence(F.expr(f"low div {STEP}"), F.expr(f"(high - 1) div {STEP}"))).alias("step"))
    placed = linked.withColumn("step", F.expr(f"rank div {STEP}")).join(runs, ["key", "step"]).where("rank >= low and rank < high").select("num", "shard")
    placed = cut(_ranks(placed, ["shard"], n).select("num", "shard", F.col("rank").alias("slot")), "placed-rows")
    kept = placed.where(F.col("slot") < n // shards + (F.col("shard") < n % shards).cast("int"))
    load = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    gaps, at = [], 0  # places that are left, shard by shard
    for s, q in enumerate(quota):
        if left := q - load.get(s, 0):
            gaps.append((s, at, load.get(s, 0)))
            at += left
    rest = _ranks(rows.select("num").join(kept.select("num"), "num", "left_anti"), [], n)
    return rows.join(kept.select("num", "shard", "slot").union(rest.select("num", *_place(gaps, F.col("rank")))), "num")


def _place(gaps: list[tuple[int, int, int]], rank: Column) -> list[Column]:
    """Shard and slot of the rank-th place that is left; gaps: (shard, first rank, first slot)."""
    found = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).cast("bigint").alias("a"), F.lit(f).cast("bigint").alias("f")) for s, a, f in gaps or [(0, 0, 0)]])
    own = F.element_at(F.filter(found, lambda g: g["a"] <= rank), -1)
    return [own["s"].alias("shard"), (rank - own["a"] + own["f"]).alias("slot")]


def shard_documents(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, text_group) for every row of docs.

    Shards go from 0; their counts differ by one at most (law 'rows'), and slots go from 0 in each without a gap. Rows of equal
    texts are linked, and so are rows of the ids that links (a, b) name; a pair named more than once weighs more. size: UTF-8
    bytes and 16; text_crc32: of them, 0 for null; text_group: a digest of the text, null for null; grown_shard: null, as the law isn't
    'key'. Null texts are linked by links alone, empty ones are equal texts. Each row counts for itself, also where ids repeat or are
    null; links name all rows of an id; those with a null end, within a text or to ids that aren't there count for nothing.
    An empty table gives no rows. Other columns are not read. Reruns over the same files agree.
    """
    out = _plan(docs, shards, links, id_col, text_col, rounds, False)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_group")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, links: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Writes docs as Parquet under path, a folder for each shard, ordered by slot in and across its files; returns what was written.

    All columns are kept, with shard and slot beside them, so docs must not have columns of these names.
    """
    if {c.lower() for c in docs.columns} & {"shard", "slot"}:
        raise ValueError("docs have a column shard or slot")
    out = _plan(docs, shards, links, id_col, text_col, rounds, True).select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(out.columns)


def op11(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_group")
