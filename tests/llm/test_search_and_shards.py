"""Sharding, hard negatives and lexical search against brute force, with nulls, odd texts, ties, repeats and clashing columns."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import hard_negatives, lexical_search, sharding
from glyphmill.llm.queries import ORACLE_SQL, QUERIES
from glyphmill.llm.scratch import new_path
from tests.compare import rows
from tests.llm.test_operators import ALNUM, corpus, words


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*x, "k", 1, "c", 2, 3) for x in corpus()], "doc_id bigint, text string, source string, id string, n int, key string, shard int, rank int")
    return df.repartition(3).cache()


# --- 11 ---


def shards_of(found, shards: int) -> list:
    got = found.collect()
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(got) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    return got


@pytest.mark.parametrize("shards", [4, 100])
def test_shards(docs, shards):
    got = shards_of(sharding.shard_documents(docs, shards), shards)
    texts = {i: t for i, t, _ in corpus() if i is not None}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in corpus())
    for r in got:
        raw = (texts[r.doc_id] if r.doc_id is not None else texts[2]) or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw.encode()) + 16, zlib.crc32(raw.encode()), "rows", None)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs, shards).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    if shards == 4:
        where: dict = {}
        for r in got:
            if r.text_group is not None:
                where.setdefault(bytes(r.text_group), set()).add(r.shard)
        assert all(len(s) == 1 for s in where.values())


def test_shards_of_odd_tables(docs):
    assert sharding.shard_documents(docs.limit(0), 3).collect() == []
    got = shards_of(sharding.shard_documents(docs.selectExpr("doc_id", "cast(null as string) as text"), 7), 7)
    assert {(r.size, r.text_crc32, r.text_group) for r in got} == {(16, 0, None)}
    shards_of(sharding.shard_documents(docs.selectExpr("doc_id", "'' as text"), 7), 7)  # all are equal
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)


def test_a_text_of_very_many_copies(spark):
    """It fills shards one after another, about as few as can be; small groups are not cut for it."""
    texts = ["hot"] * 450 + [f"pair {k // 2}" for k in range(300)] + [f"own {k}" for k in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = shards_of(sharding.shard_documents(df, 10), 10)
    where: dict = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(where["hot"]) <= 6  # of 100 places each
    assert all(len(s) == 1 for t, s in where.items() if t != "hot")


def test_linked_texts_move_together(spark, monkeypatch):
    """Rings of different texts: links lead them into few shards, with salted ends too."""
    monkeypatch.setattr(sharding, "HEAVY", 5)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id bigint, text string").repartition(3)
    pairs = [(g * 20 + k, g * 20 + (k + d) % 20) for g in range(20) for k in range(20) for d in (1, 2, 3)] + [(None, 1), (3, 3), (5, 9999)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    cut_edges = []
    for given in (None, links):
        where = {r.doc_id: r.shard for r in shards_of(sharding.shard_documents(df, 4, given, rounds=16), 4)}
        cut_edges.append(sum(where[a] != where[b] for a, b in pairs if a is not None and b in where))
    assert cut_edges[0] > 800 and cut_edges[1] < 0.35 * cut_edges[0]


def test_written_shards(spark, docs):
    path = new_path(spark, "test")
    own = docs.drop("shard")
    got = sharding.write_shards(own, f"{path}/shards", 4)
    assert got.columns == [*own.columns, "shard", "slot"]
    key = lambda r: repr((r.doc_id, r.text, r.source))
    assert sorted(map(key, got.collect())) == sorted(map(key, own.collect()))
    assert {(r.doc_id, r.shard, r.slot) for r in got.collect()} == {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs, 4).collect()}
    with pytest.raises(ValueError):
        sharding.write_shards(docs, f"{path}/other", 4)


# --- 12 ---


def vectors() -> list[tuple]:
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 8)) * 0.5
    out: list[tuple] = [(i, [float(x) for x in (middle[i % 30] + rng.normal(size=8) * 0.05).astype(np.float32)], i % 4) for i in range(900)]
    out += [(i, out[300][1], i % 4) for i in range(900, 1100)]  # many equal ones: ties
    for i, v, label in ((17, None, 1), (200, out[200][1], None), (400, [float("nan")] * 8, 1), (401, [float("inf")] + [0.0] * 7, 1), (402, [None] + [0.5] * 7, 1), (500, [0.5] * 3, 1), (501, [0.75] * 3, 1), (502, [0.25] * 3, 2), (600, [], 1), (700, [0.0] * 8, 3)):
        out[i] = (i, v, label)
    return [*out, out[100], out[301], (None, out[3][1], 2)]


def brute_negatives(table: list[tuple]) -> list[tuple]:
    own = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in table if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, a, label) in enumerate(own):
        if i % 100:
            continue
        scored = sorted((-int(a @ b), j, other == label) for n, (j, b, other) in enumerate(own) if n != k and len(a) == len(b))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            found = [(j, -t) for t, j, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("cell", [8, 64, 1024])
def test_hard_negatives(spark, monkeypatch, cell):
    for name, value in (("CELL", cell), ("ROWS", 8), ("COLS", 4), ("COARSE", 20)):
        monkeypatch.setattr(hard_negatives, name, value)
    path = new_path(spark, "test")
    spark.createDataFrame([(*x, 1, "c", 2) for x in vectors()], "vec_id bigint, embedding array<float>, label int, num int, cell string, side int").repartition(4).write.parquet(f"{path}/embeddings.parquet")
    got = QUERIES["op12_hard_negatives"](spark, path).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == brute_negatives(vectors())


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    always = hard_negatives.F.lit(True)
    assert hard_negatives.mine(spark.createDataFrame([], schema), always).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema), always).collect() == []
    # far beyond what a long holds
    got = hard_negatives.mine(spark.createDataFrame([(1, [1e300, 1.0], 1), (2, [1e300, 2.0], 1), (3, [1e290, 0.0], 2), (4, [4000000.0, 0.0], 2)], schema), hard_negatives.F.col("vec_id") == 1).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(2, 4)]


# --- 13 ---


def brute_search(texts: list[tuple], items: list[tuple], top: int, multiplicity: bool) -> list[tuple]:
    bags = [(i, w, Counter(w)) for i, t, *_ in texts if (w := words(ALNUM, t))]
    n, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, w, bag in bags:
            m = 10 + 90 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (k if multiplicity else 1) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, k in Counter(words(ALNUM, text)).items() if t in bag)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def search_items() -> list[tuple]:
    t = {i: x for i, x, _ in corpus()}
    long = words(ALNUM, t[24])
    return [(1, " ".join(long[5:30])), (2, "One, two!"), (3, None), (4, "..."), (5, " ".join(long[40:49]) + " ONE one one"), (6, "nowhere-to-be-found"), (1, " ".join(long[5:30])), (None, "x1 x1 été"), (7, t[22])]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("multiplicity", [False, True])
def test_search(spark, docs, monkeypatch, small, multiplicity):
    if small:
        for name, value in (("BITS", 64), ("BLOCK_TERMS", 50), ("DOCS", 3), ("POSTINGS", 70)):
            monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame([(*x, "c", 1, 2) for x in search_items()], "item_id bigint, text string, code string, row int, item int").repartition(2)
    got = lexical_search.search(docs, items, top=7, multiplicity=multiplicity)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == brute_search(corpus(), search_items(), 7, multiplicity)


def test_search_in_odd_tables(spark, docs):
    items = spark.createDataFrame(search_items(), "item_id bigint, text string")
    none = docs.selectExpr("doc_id", "cast(null as string) as text")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (none, items), (docs, items.where("item_id = 6"))):
        got = lexical_search.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_search_query(spark, duck, docs):
    """Its SQL and brute force agree on odd texts."""
    path = new_path(spark, "test")
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(search_items()[:6], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    got = QUERIES["op13_lexical_search"](spark, path).toPandas()
    one = corpus()[:-2]
    assert sorted(map(tuple, got[["item_id", "rank", "doc_id", "score"]].values.tolist()), key=repr) == brute_search(one, search_items()[:6], 10, False)
    con = duck.cursor()
    for t in ("documents", "benchmark"):
        con.sql(f"create or replace temp view {t} as select * from '{path.removeprefix('file://')}/{t}.parquet/*.parquet'")
    assert rows(con.sql(ORACLE_SQL["op13_lexical_search"]).df()) == rows(got)
