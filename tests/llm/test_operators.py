"""Operators against brute force, on small tables with nulls, empty and very long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, embedding_dedup, license_scan, mixing, ngram_join, quality, substring_dedup, token_store, url_filter, warc_convert
from glyphmill.llm.queries import ORACLE_SQL, QUERIES
from glyphmill.llm.scratch import new_path
from tests.compare import rows

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(pattern: re.Pattern, text: str | None) -> list[str]:
    return pattern.findall((text or "").translate(LOWER))


def corpus() -> list[tuple]:
    """(doc_id, text, source) with near copies, exact copies, passages, odd texts and a repeated row."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeinorst") for _ in range(r.randint(1, 8))) for _ in range(300)] + ["été", "naïve", "x1", "don't", "A.B"]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts: list[str | None] = []
    base = make(120)
    for k in range(12):
        own = list(base)
        for _ in range(k):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[3] + "\n", None, "", " \t\n", "one", "one two three four", "ONE two three four", "x" * 5000, " ".join(make(30_000))]
    passage = " ".join(make(60)) + "."
    texts += [" ".join(make(50)) + ".\n" + passage + "\n" + " ".join(make(r.randint(5, 90))) + "." for _ in range(8)]
    texts += ["\n".join(" ".join(make(r.randint(1, 20))) + "." for _ in range(r.randint(1, 8))) for _ in range(30)]
    out = [(i, t, [None, "b", "a", "c"][i % 4]) for i, t in enumerate(texts)]
    return [*out, out[5], (None, texts[2], "a")]


@pytest.fixture(scope="module")
def docs(spark):
    # more columns, with names that operators use themselves
    df = spark.createDataFrame([(*x, "k", 1, "c") for x in corpus()], "doc_id bigint, text string, source string, id string, n int, _statistics string").repartition(3)
    return df.withColumnsRenamed({}).selectExpr("*", "'o' as _other", "1 as size", "'p' as row", "2 as component").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def without_nulls(found, key: str) -> dict:
    return {r[key]: r for r in found.collect() if r[key] is not None}


# --- 1 ---


@pytest.fixture(scope="module")
def benchmark(spark):
    t = {i: x for i, x, _ in corpus()}
    long = words(ALNUM, t[24])
    items = [(1, " ".join(long[5:30])), (2, "One, two!"), (3, None), (4, "..."), (5, " ".join(long[40:49])), (6, "nothing of this is anywhere in those texts at all you see"), (10, " ".join(long[5:30])), (None, " ".join(long[:20])), (7, "été")]
    return spark.createDataFrame(items, "item_id bigint, text string")


def brute_contamination(texts: list[tuple], items: list[tuple]) -> list[tuple]:
    out = []
    for i, text, *_ in texts:
        w, hit, met = words(ALNUM, text), set(), set()
        for item, it in items:
            v = words(ALNUM, it)
            if item is None or not v:
                continue
            n = min(10, len(v))
            wanted = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit |= set(range(k, k + n))
                    met.add(str(item))
        out.append((i, len(w), len(hit), sorted(met)))
    return out


def test_contamination(docs, benchmark):
    found = decontamination.find_contamination(docs, benchmark).collect()
    got = [(r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in found]
    want = brute_contamination(corpus(), [tuple(r) for r in benchmark.collect()])
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(w[2] for w in want)


def test_contamination_block_by_block(docs, benchmark, monkeypatch):
    whole = [tuple(r) for r in decontamination.find_contamination(docs, benchmark).collect()]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert sorted(map(repr, whole)) == sorted(repr(tuple(r)) for r in decontamination.find_contamination(docs, benchmark).collect())


def test_decontaminated_rows_are_whole(docs, empty, benchmark):
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [x[0] for x in brute_contamination(corpus(), [tuple(r) for r in benchmark.collect()]) if not x[2]]
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in kept.collect())
    assert decontamination.find_contamination(empty, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == docs.count()


def test_items_without_ids(spark, tmp_path):
    import duckdb

    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "v " * 20), (4, "u1 u2")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, text[8:60]), (7, text[30:80]), (None, "u1 u2"), (None, None)], "item_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(QUERIES["op1_decontamination"](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLE_SQL["op1_decontamination"]).df())
    assert [r.doc_id for r in decontamination.decontaminate(docs, items).collect()] == [3]


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    for w in (1, 2, 3, 6, 7):
        for n in (1, 2, 5, 40):
            x = r.integers(0, 6, n).astype(np.uint64)
            kept = decontamination.winnow(x, w)
            for i in range(max(1, n - w + 1)):
                assert kept[i : i + w].any() and (x[i : i + w] == x[i : i + w].min())[kept[i : i + w]].any()


# --- 2 ---


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    path = new_path(spark, "test")
    token_store.write_store(docs, path, token_store.tokenizer_file())
    found = sorted(token_store.verify_store(spark, path).collect(), key=lambda r: r.start)
    ids = [r["ids"] for r in sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)]
    t = Tokenizer.from_file(token_store.tokenizer_file())
    order = sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    assert len(found) == len(order)
    for r, own, (i, text, _) in zip(found, ids, order):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.id, r.start, r.n_tokens, r.crc) == (i, start, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        assert own == want
        start += len(want)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert [r.n_tokens for r in manifest if r.shard is None] == [start]
    nothing = new_path(spark, "test")
    token_store.write_store(empty, nothing, token_store.tokenizer_file())
    assert token_store.verify_store(spark, nothing).count() == 0


def _rewritten(spark, path: str, part: str, change) -> None:
    """A part of a store written anew after change, with its partition columns."""
    import shutil

    local = path.removeprefix("file://")
    by = ["kind"] if part == "index" else []
    change(spark.read.parquet(f"{path}/{part}")).write.partitionBy(*by).parquet(f"{path}/other")
    shutil.rmtree(f"{local}/{part}")
    shutil.move(f"{local}/other", f"{local}/{part}")


DAMAGES = {
    "a chunk is missing": ("chunks", lambda t: t.where("n < 100")),
    "a chunk is there twice": ("chunks", lambda t: t.union(t.limit(1))),
    "a payload is changed": ("chunks", lambda t: t.withColumn("payload", F.expr("overlay(payload placing X'0707' from 1 for 2)"))),
    "recipes are missing": ("index", lambda t: t.where("kind = 'shard' or local_start % 2 = 0")),
    "a recipe is there twice": ("index", lambda t: t.union(t.where("kind = 'document'").limit(1))),
    "a recipe has moved": ("index", lambda t: t.withColumn("local_start", F.expr("if(kind = 'document' and local_start > 0, local_start + 1, local_start)"))),
    "a recipe has other chunks": ("index", lambda t: t.withColumn("digests", F.reverse("digests"))),
    "a shard's row is changed": ("index", lambda t: t.withColumn("n_docs", F.expr("if(kind = 'shard', n_docs - 1, n_docs)"))),
    "a shard's row is missing": ("index", lambda t: t.where("kind = 'document'")),
    "the shards begin elsewhere": ("manifest", lambda t: t.withColumn("start", F.expr("start + 1000"))),
    "roots are zeroed": ("manifest", lambda t: t.withColumn("root", F.lit(bytearray(16)))),
    "the root of all is changed": ("manifest", lambda t: t.withColumn("root", F.when(F.col("shard").isNull(), F.lit(bytearray(16))).otherwise(F.col("root")))),
    "a shard isn't in the manifest": ("manifest", lambda t: t.where("shard is null or shard > 0")),
    "the manifest has no end": ("manifest", lambda t: t.where("shard is not null")),
    "counts are changed": ("manifest", lambda t: t.withColumn("n_tokens", F.expr("n_tokens + 1"))),
}


@pytest.fixture(scope="module")
def store(spark, docs):
    path = new_path(spark, "test")
    token_store.write_store(docs, path, token_store.tokenizer_file())
    return path


@pytest.mark.parametrize("damage", DAMAGES)
def test_a_damaged_store_is_noticed(spark, store, damage):
    import shutil

    path = new_path(spark, "test")
    shutil.copytree(store.removeprefix("file://"), path.removeprefix("file://"))
    _rewritten(spark, path, *DAMAGES[damage])
    for read in (token_store.verify_store, token_store.read_store):
        with pytest.raises(Exception, match="ValueError|there twice"):
            read(spark, path).collect()


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    own = json.loads(open(token_store.tokenizer_file()).read())
    assert token_store.cuts_like_bytes(Tokenizer.from_file(token_store.tokenizer_file()))
    for k, change in enumerate([{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(own | change))
        e = token_store.Encoder(str(path))
        assert not e.in_pieces
        texts = ["Héllo  World, it's.", "", None, "x y z w v"]
        ids, bounds = e.encode(pa.array(texts), 2)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_op2_query(spark, docs):
    from tokenizers import Tokenizer

    path = new_path(spark, "test")
    docs.where("doc_id is not null").distinct().write.parquet(f"{path}/documents.parquet")
    t = Tokenizer.from_file(token_store.tokenizer_file())
    want, start = [], 0
    for i, text in sorted({i: text for i, text, _ in corpus() if i is not None}.items()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_token_store"](spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


@pytest.mark.parametrize("text", ["", "a  b", "  x", "x \n\n y", "l'eau, it's 'quoted' don't", "“q” — z", "a\u00a0 b\u3000c", "tab\t\tend ", "<|endoftext|>a<|endoftext|> b", "é😀 😀", "a\x1cb", "x.y,z!? 12a b3", "word" * 999, "Été à ×÷ a×b ÿ Øre\nÉtat ñ, ü.", "été " * 50])
def test_encoder_agrees_with_the_whole_text(text):
    import pyarrow as pa

    e = token_store.Encoder(token_store.tokenizer_file())
    ids, bounds = e.encode(pa.array([text, None, "q " + text]), 2)
    for k, t in enumerate([text, "", "q " + text]):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_merkle_trees_agree():
    leaves = [hashlib.blake2b(bytes([i]), digest_size=16).digest() for i in range(37)]
    for n in range(38):
        tree = token_store._Growing()
        for x in leaves[:n]:
            tree.add(x)
        assert tree.root() == token_store.merkle_root(leaves[:n])


# --- 3 ---


def brute_components(texts: list[tuple]) -> dict:
    sets = []
    for i, t, *_ in texts:
        w = words(SPACED, t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, u in sets:
            if a is not None and b is not None and a < b and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets if i is not None}


@pytest.mark.parametrize("large", [16, 2])
def test_near_duplicates(docs, monkeypatch, large):
    monkeypatch.setattr(ngram_join, "LARGE", large)
    got = {i: (r.n_shingles, r.component) for i, r in without_nulls(ngram_join.near_duplicates(docs), "doc_id").items()}
    assert got == brute_components(corpus())
    assert len(set(c for _, c in got.values())) < len(got)


def test_near_duplicates_without_the_first_round(docs, monkeypatch):
    """The product alone finds every link, also in small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    real = ngram_join.verify
    calls = []

    def none_first(texts, pairs):
        calls.append(1)
        return real(texts, pairs.limit(0) if len(calls) == 1 else pairs)

    monkeypatch.setattr(ngram_join, "verify", none_first)
    got = {i: (r.n_shingles, r.component) for i, r in without_nulls(ngram_join.near_duplicates(docs), "doc_id").items()}
    assert got == brute_components(corpus())


def test_one_of_each_group(docs, empty):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(str(i) for i, *_ in corpus() if i is None or brute_components(corpus())[i][1] == i)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert ngram_join.near_duplicates(empty).count() == 0


# --- 4 ---

PAGES = [
    (1, "http://www.Example.org/en/1?x", '<a href="http://good.net/x">'), (2, "https://example.org/es/9", "<a href='//Bad.com/'>"), (3, "http://bad.com/de/1", None), (4, "http://bad.com/en/", '<a href="http://far.net/"> <a href=http://bad.com/de/>'),
    (5, "http://good.net/a", ""), (6, "http://linker.net/", '<a href="http://bad.com/de/1">'), (7, None, "x"), (8, "no scheme", "x"), (9, "http://x.fr.com/fr/", "<a href='http://good.net'>"), (10, "http://org", ""), (10, "http://org", ""),
    (11, "http://a?b://c/d", ""), (12, "ftp://u@shop.com:80/de/x#y", ""), (None, "http://example.org/", ""),
]


def brute_rule(url: str | None) -> tuple:
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    pages = spark.createDataFrame([(*p, "h", "r") for p in PAGES], "page_id bigint, url string, html string, host string, rule string")
    got = url_filter.filter_urls(pages).collect()
    assert sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in got) == sorted(repr((p[0], *brute_rule(p[1]))) for p in PAGES)
    verdict = {r.page_id: r.verdict for r in got}
    for p in PAGES:
        if (rule := brute_rule(p[1])[2]) is not None:
            assert verdict[p[0]] == next(v for v, r in url_filter.RULES if r == rule)
    assert verdict[5] == "allow" and verdict[6] == "block"  # trusted pages link there; it links to a blocked host
    assert verdict[7] == verdict[8] == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_propagation_against_dense_iteration(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 2), ("c", "a", 1), ("c", "d", 1), ("d", "e", 5)]
    got = {r.host: r.amount for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight bigint"), spark.createDataFrame([("a", 1_000_000_000)], "host string, amount bigint")).collect()}
    names = "abcde"
    m = np.zeros((5, 5))
    for s, d, w in edges:
        m[names.index(d), names.index(s)] = w / sum(x[2] for x in edges if x[0] == s)
    seed = np.array([1e9, 0, 0, 0, 0])
    x = seed.copy()
    for _ in range(url_filter.ROUNDS):
        x = 0.15 * seed + 0.85 * m @ x
    for n, v in zip(names, x):
        assert got.get(n, 0) == pytest.approx(v, rel=1e-4, abs=100)


def test_distrust_reaches_far_rings(spark):
    link = '<a href="http://{}/">'
    pages = [("http://bad.com/de/1", "")] + [(f"http://r{k}.net/", link.format("bad.com")) for k in range(1000)] + [(f"http://s{k}.net/", link.format("r0.net")) for k in range(1000)] + [("http://t0.net/", link.format("s0.net")), ("http://far.net/", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.host: r for r in url_filter.filter_urls(df).collect()}
    assert all(got[f"s{k}.net"].verdict == "block" for k in range(1000)) and got["t0.net"].verdict == "block"
    assert got["s0.net"].distrust == pytest.approx(1e6 * 0.15 * 0.85**2 / 1000 / 1000, rel=1e-6)
    assert got["far.net"].verdict == "allow" and got["far.net"].distrust == 0


def brute_verdicts(pages: list[tuple], domains: bool) -> dict:
    """(trust, distrust, verdict by the method) of each host."""
    allowed, blocked, links = {}, {}, {}
    for _, url, html in pages:
        host, _, rule = brute_rule(url)
        verdict = next((v for v, r in url_filter.RULES if r == rule), None)
        allowed[host] = allowed.get(host, 0) + (verdict == "allow")
        blocked[host] = blocked.get(host, 0) + (verdict == "block")
        found = re.findall(r"""\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "", re.I) if host else []
        for to in {re.sub(r"^[^@]*@|:\d*$", "", x).translate(LOWER) for x in dict.fromkeys(found)}:
            if to and to != host:
                links[host, to] = links.get((host, to), 0) + len({x for x in found if re.sub(r"^[^@]*@|:\d*$", "", x).translate(LOWER) == to})
    if domains:
        pairs = set()
        for host in allowed:
            labels = host.split(".")
            if not re.fullmatch(r"[\d.:]*", host):
                pairs |= {(".".join(labels[k:]), ".".join(labels[k + 1 :])) for k in range(len(labels) - 2)}
        for a, b in pairs:
            links[a, b], links[b, a] = links.get((a, b), 0) + 1, links.get((b, a), 0) + 1

    def spread(links: dict, seeds: dict) -> dict:
        total: dict = {}
        for (a, _), w in links.items():
            total[a] = total.get(a, 0) + w
        now = {h: 1e6 * n for h, n in seeds.items() if n}
        base = dict(now)
        for _ in range(url_filter.ROUNDS if links and base else 0):
            new = {h: 0.15 * v for h, v in base.items()}
            for (a, b), w in links.items():
                if a in now:
                    new[b] = new.get(b, 0) + 0.85 * now[a] * w / total[a]
            now = new
        return now

    good, bad = spread(links, allowed), spread({(b, a): w for (a, b), w in links.items()}, blocked)
    return {h: (good.get(h, 0), bad.get(h, 0), "block" if bad.get(h, 0) > good.get(h, 0) else "allow") for h in allowed}


def graph_pages() -> list[tuple]:
    r = random.Random(4)
    hosts = [f"{a}{b}.example.{c}" for a in ("", "www.", "m.") for b in "pqrstuv" for c in ("com", "org", "net")] + ["10.0.0.7", "example.org", "deep.er.www.p.example.net", "lone.net"]
    link = lambda: f'<a href="{r.choice(["http://", "//", "HTTPS://me@"])}{r.choice(hosts)}{r.choice(["", "/x", ":80/y?z"])}"> <img src=/own.png>'
    pages = [(i, f"https://{r.choice(hosts)}/{r.choice(['fr', 'de', 'en', 'es'])}/{i}", "".join(link() for _ in range(r.choice([0, 0, 1, 3])))) for i in range(200)]
    pages += [pages[3], pages[3], (900, "https://far.example.net/x", '<base href="//p.example.com/"><a href="y">' + "z" * 1_000_000), (901, "http://u.net/", None)]
    return pages


@pytest.mark.parametrize("domains", [True, False])
def test_all_verdicts_against_brute_force(spark, domains):
    pages = graph_pages()
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    want = brute_verdicts(pages, domains)
    got = url_filter.filter_urls(df, domains=domains).collect()
    assert len(got) == len(pages)
    verdicts = set()
    for r in got:
        trust, distrust, method = want[r.host]
        assert (r.trust, r.distrust) == (pytest.approx(trust, rel=1e-7), pytest.approx(distrust, rel=1e-7))
        own = next((v for v, x in url_filter.RULES if x == r.rule), None)
        assert r.verdict == (own or method)
        verdicts |= {(own, r.verdict)}
    assert {(None, "allow"), (None, "block")} <= verdicts


def test_op4_query(spark):
    path = new_path(spark, "test")
    pages = graph_pages()
    spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, verdict string").write.parquet(f"{path}/pages.parquet")
    want = brute_verdicts(pages, True)
    rules = dict((r, v) for v, r in url_filter.RULES)
    got = QUERIES["op4_url_filter"](spark, path).collect()
    assert sorted((r.page_id, r.host, r.path, repr(r.rule), r.verdict) for r in got) == sorted((i, h, p, repr(rule), rules.get(rule) or want[h][2]) for i, (h, p, rule) in ((i, brute_rule(u)) for i, u, _ in pages))


# --- 5 ---


def brute_units(text: str | None) -> list[tuple]:
    out, text = [], text or ""
    matches = list(ALNUM.finditer(text.translate(LOWER)))
    begin = 0
    for k, m in enumerate(matches):
        if k and re.search(r"[\n.!?]", text[matches[k - 1].end() : m.start()]):
            out.append((tuple(x[0] for x in matches[begin:k]), matches[begin].start(), m.start()))
            begin = k
    if matches:
        out.append((tuple(x[0] for x in matches[begin:]), matches[begin].start(), len(text)))
    return out


def brute_removed(texts: list[tuple]) -> dict:
    units = {i: brute_units(t) for i, t, *_ in texts if i is not None}
    first: dict = {}
    for i in sorted(units):
        for k, (w, *_) in enumerate(units[i]):
            first.setdefault(w, (i, k))
    out = {}
    for i, own in units.items():
        k = 0
        while k < len(own):
            e = k
            while e < len(own) and first[own[e][0]] != (i, e):
                e += 1
            shared: dict = {}
            for w, *_ in own[k:e]:
                shared[first[w][0]] = shared.get(first[w][0], 0) + len(w)
            if max(shared.values(), default=0) >= substring_dedup.RUN_WORDS:
                out.setdefault(i, []).append((own[k][1], own[e - 1][2], sum(len(w) for w, *_ in own[k:e]), sorted({first[w][0] for w, *_ in own[k:e]})))
            k = e + 1
    return out


def test_passages(docs, empty):
    got = {r.doc_id: [(s["start"], s["end"], s["words"], list(s["kept_in"])) for s in r.removed] for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == brute_removed(corpus())
    assert got
    texts = {i: t for i, t, _ in corpus()}
    for r in substring_dedup.remove_passages(docs).collect():
        t = texts[r.doc_id] if r.doc_id is not None else texts[2]
        for s, e, *_ in reversed(got.get(r.doc_id, [])):
            t = t[:s] + t[e:]
        assert r.text == t
    assert substring_dedup.remove_passages(empty).count() == 0


def test_short_units_and_whole_lines(spark):
    verse = "\n".join(f"row {k} w{k}" for k in range(20))
    texts = [verse, "", "first of all\n" + verse, "Some words here. And more of them.\nelse", "other\nsome words here, and more of them!\nlast", "a b c\nd e f\n\nx", "y\n\na b\nc d e f\n \nz", "in a line of many, else, it is not whole"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    short = {r.doc_id: r.removed for r in substring_dedup.repeated_passages(df).collect()}
    assert {i: [(s["words"], s["kept_in"]) for s in x] for i, x in short.items()} == {2: [(60, [0])]}
    got = {r.doc_id: r.text for r in substring_dedup.remove_passages(df, whole=1).collect()}
    assert got == dict(enumerate(texts)) | {2: "first of all\n", 4: "other\nlast", 6: "y\n\nz"}
    got = {r.doc_id: r.text for r in substring_dedup.remove_passages(df, whole=6).collect()}
    assert got == dict(enumerate(texts)) | {2: "first of all\n", 4: "other\nlast", 6: "y\n\nz"}
    got = {r.doc_id: r.text for r in substring_dedup.remove_passages(df, whole=8).collect()}
    assert got == dict(enumerate(texts)) | {2: "first of all\n"}


def test_chance_repeats_from_many_documents_stay(spark):
    lines = [f"this line number {k} is met in many texts." for k in range(8)]
    texts = [*lines, "new words. " + " ".join(lines), "\n".join(reversed(lines)) + "\nanother end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert substring_dedup.repeated_passages(df).count() == 0
    copied = spark.createDataFrame([*enumerate(texts), (20, "it says. " + " ".join(lines[:4])), (21, "so. " + lines[7] + " x y z. " + lines[0])], "doc_id bigint, text string")
    assert substring_dedup.repeated_passages(copied).count() == 0
    passage = "one passage begins here and has some words. it goes on with others, of which it has many. and ends."
    twice = spark.createDataFrame([(1, "a b " + passage), (2, "c. d e.\n" + passage + "\nf"), (3, passage)], "doc_id bigint, text string")
    got = {r.doc_id: [(s["words"], s["kept_in"]) for s in r.removed] for r in substring_dedup.repeated_passages(twice, run_words=10).collect()}
    assert got == {2: [(12, [1])], 3: [(20, [1, 2])]}


def test_rows_of_one_id_lose_their_own_repeats(spark):
    """Rows of one id with different texts: what one holds is not cut out of the other."""
    a, b = " ".join(f"w{k}" for k in range(30)) + ".", " ".join(f"v{k}" for k in range(40)) + "."
    df = spark.createDataFrame([(0, a), (1, a), (1, b), (2, b), (2, b), (None, a)], "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in substring_dedup.remove_passages(df, whole=20).collect()]
    assert sorted(got, key=repr) == sorted([(0, a), (1, ""), (1, b), (2, ""), (2, ""), (None, a)], key=repr)
    found = substring_dedup.repeated_passages(df, whole=20).collect()
    assert sorted((r.doc_id, len(r.removed)) for r in found) == [(1, 1), (2, 1)]
    alone = substring_dedup.repeated_passages(df.where("doc_id <> 1 or text like 'w%'"), whole=20).collect()
    assert {r["copy"] for r in alone} == {0}


def test_op5_query(spark, docs):
    path = new_path(spark, "test")
    docs.write.parquet(f"{path}/documents.parquet")
    removed = {r.doc_id: r for r in substring_dedup.remove_passages(docs, all_rows=False, whole=substring_dedup.WHOLE_WORDS).collect()}
    got = QUERIES["op5_substring_dedup"](spark, path).collect()
    assert {r.doc_id for r in got} == set(removed) and got
    texts = {i: t for i, t, _ in corpus()}
    for r in got:
        spans = removed[r.doc_id].removed
        assert (r.n_removed, r.removed_words) == (len(spans), sum(len(words(ALNUM, texts[r.doc_id][s.start : s.end])) for s in spans))
        assert r.kept_in == sorted({k for s in spans for k in s.kept_in})
        out = texts[r.doc_id]
        for s in reversed(spans):
            out = out[: s.start] + out[s.end :]
        assert r.text == out


# --- 6 ---


def vectors() -> list[tuple]:
    r = np.random.default_rng(5)
    centers = r.normal(size=(6, 16))
    out = [(i, (centers[i % 6] + 0.12 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(120)]
    out += [(200, out[0][1]), (201, [2 * x for x in out[0][1]]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1.0] * 3), (206, [None] + [1.0] * 15), (207, [float("inf")] + [0.0] * 15), (208, [1e38] * 16), (209, [1e-40] * 16), (210, out[0][1])]
    return [*out, (None, out[1][1])]


def test_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors()], "vec_id bigint, embedding array<float>, label int, home string")
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors() if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= 0.95} for i in unit}
    parent = {i: i for i, _ in vectors() if i is not None}
    moved = True
    while moved:
        moved = False
        for i in links:
            low = min([parent[i], *(parent[j] for j in links[i])])
            moved |= low < parent[i]
            parent[i] = low
    want = {i: (len(links.get(i, ())), parent[i], parent[i] == i) for i in parent}
    for cell, block, coarse in ((4096, 4096, 1024), (10, 8, 1024), (4, 3, 2)):
        for name, value in (("CELL", cell), ("ROWS", block), ("COLS", 2 * block), ("COARSE", coarse)):
            monkeypatch.setattr(embedding_dedup, name, value)
        got = {i: (r.n_links, r.component, r.kept) for i, r in without_nulls(embedding_dedup.near_vectors(df, spread=None), "vec_id").items()}
        assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("coarse", [1024, 4])
def test_closer_borders_find_nearly_all(spark, monkeypatch, coarse):
    """Vectors spread evenly over the sphere, the worst case for cells, a quarter with neighbours just inside the threshold, and a dense group."""
    r = np.random.default_rng(8)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = r.normal(size=(1000, 64))
    w -= np.sum(w * x[:1000], axis=1)[:, None] * x[:1000]
    w /= np.linalg.norm(w, axis=1)[:, None]
    c = r.uniform(0.951, 0.97, 1000)[:, None]
    x = np.concatenate([x, c * x[:1000] + np.sqrt(1 - c * c) * w, x[:1] + 0.02 * r.normal(size=(200, 64))])
    x = x.astype(np.float32)
    for name, value in (("CELL", 100), ("COARSE", coarse), ("ROWS", 70), ("COLS", 90)):
        monkeypatch.setattr(embedding_dedup, name, value)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {q.vec_id: q.n_links for q in embedding_dedup.near_vectors(df).collect()}
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() % 2 == 0
    assert found.sum() >= 0.95 * want.sum()
    alone = (want > 0) & (np.arange(len(x)) % 50 == 0)
    assert found[alone].sum() >= 0.95 * want[alone].sum()
    lonely = np.arange(1, 1000)
    assert found[lonely].sum() >= 0.95 * want[lonely].sum()
    print("recall", found.sum() / want.sum(), found[lonely].sum() / want[lonely].sum())


def test_vectors_of_repeated_ids_and_of_each_length(spark, monkeypatch):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [(5, a), (5, b), (9, b), (7, a), (3, c), (5, b), (11, [1.0, 0.0]), (12, [2.0, 0.1]), (13, [0.0, 1.0]), (14, []), (15, None)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    want = [(3, 0, 3), (5, 1, 5), (5, 2, 5), (5, 2, 5), (7, 1, 5), (9, 2, 5), (11, 1, 11), (12, 1, 11), (13, 0, 13), (14, 0, 14), (15, 0, 15)]
    for cell, block in ((4096, 4096), (1, 1)):
        monkeypatch.setattr(embedding_dedup, "CELL", cell)
        monkeypatch.setattr(embedding_dedup, "ROWS", block)
        monkeypatch.setattr(embedding_dedup, "COLS", block)
        assert sorted((r.vec_id, r.n_links, r.component) for r in embedding_dedup.near_vectors(df).collect()) == want


# --- 7 ---


def test_mix(spark, docs, empty, monkeypatch):
    got = mixing.mixing_plan(docs).collect()
    assert len(got) == len(corpus())
    assert sorted(repr((r.doc_id, r["size"])) for r in got) == sorted(repr((i, len(SPACED.findall(t or "")))) for i, t, _ in corpus())
    totals: dict = {}
    for r in got:
        size, copies, target, largest = totals.setdefault(r.source, [0, 0, r.mix["target"], 0])
        totals[r.source] = [size + r["size"], copies + r["size"] * r.copies, target, max(largest, r["size"])]
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies
    everything = sum(t[0] for t in totals.values())
    assert sum(t[2] for t in totals.values()) == pytest.approx(everything)
    weights = dict(zip(sorted(totals, key=lambda s: (s is None, s or "")), [1, 2, 3, 1]))
    want, open_ = {s: 0.0 for s in totals}, set(totals)
    while open_:  # share, stop at the cap, share again
        rest = everything - sum(want[s] for s in totals if s not in open_)
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * totals[s][0]}
        for s in full or open_:
            want[s] = min(3.0 * totals[s][0], level * weights[s])
        open_ = open_ - full if full else set()
    for s, (_, taken, target, largest) in totals.items():
        assert target == pytest.approx(want[s])
        assert abs(taken - target) <= largest / 2
    assert rows(mixing.mixing_plan(docs).select("doc_id", "copies").toPandas()) == rows(mixing.mixing_plan(docs).select("doc_id", "copies").toPandas())
    sizes = docs.selectExpr("doc_id as id", "source", "1 as size")
    for block_docs, run in ((256, 64), (2, 2)):  # each document's shards by walking over the leaves
        plan, leaves, n_shards = mixing.plan_sources(sizes, block_docs=block_docs)
        ends: dict = {}
        for r in leaves.collect():
            for x in r.places:
                ends.setdefault((r["rank"], x["copy"], x["node"]), set()).add(x["end"])
        assert n_shards == 4 and {n for _, _, n in ends} <= set(range(4))
        given = mixing.assign(sizes, plan, leaves, "id").collect()
        by = {r.source: r for r in plan.collect()}
        units: dict = {}
        for r in given:
            assert len(r.shards) == r.copies and None not in r.shards
            for c, shard in enumerate(r.shards):
                units.setdefault((r.source, shard), set()).add(c)
        for r in by.values():  # units of a source are dealt whole, in order
            spans = sorted((c * r.n_blocks + max(e), n) for (k, c, n), e in ends.items() if k == r["rank"])
            assert [n for _, n in spans] == sorted(n for _, n in spans)
            assert not spans or spans[-1][0] == r.units
        monkeypatch.setattr(mixing, "RUN", 2)
    mixed = mixing.mix(docs)
    assert mixed.rdd.getNumPartitions() > 4
    order = [r.doc_id for r in mixed.collect()]
    monkeypatch.setattr(mixing, "PIECES_A_CORE", 1)
    assert [r.doc_id for r in mixing.mix(docs).collect()] == order
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def test_op7_query(spark, docs):
    path = new_path(spark, "test")
    docs.write.parquet(f"{path}/documents.parquet")
    got = QUERIES["op7_mixing"](spark, path).collect()
    sizes: dict = {}
    for _, t, source in corpus():
        sizes[source] = sizes.get(source, 0) + len(SPACED.findall(t or ""))
    largest = {s: max(len(SPACED.findall(t or "")) for _, t, x in corpus() if x == s) for s in sizes}
    source = {(i, len(SPACED.findall(t or ""))): s for i, t, s in corpus()}
    assert sorted(repr((r.doc_id, r["size"])) for r in got) == sorted(repr((i, len(SPACED.findall(t or "")))) for i, t, _ in corpus())
    taken, target = dict.fromkeys(sizes, 0), {}
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and target.setdefault(s, r.target) == r.target
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 3
        taken[s] += r.taken
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 and target[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, QUERIES["op7_mixing"](spark, path).collect()))


def test_hypergeometric_draws(spark):
    from pyspark.sql import functions as F

    u = "(pmod(xxhash64(id), 9007199254740992) / 9007199254740992D)"
    for n, total, drawn in ((10, 20, 10), (3, 60, 30), (0, 9, 4), (5, 5, 2), (400, 1000, 500)):
        r = spark.range(4000).select(F.expr(mixing.hypergeometric(f"{n}L", f"{total}L", f"{drawn}L", u)).alias("k")).agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
        mean, var = drawn * n / total, drawn * n / total * (1 - n / total) * (total - drawn) / max(1, total - 1)
        assert r[0] == pytest.approx(mean, abs=0.1 + 4 * (var / 4000) ** 0.5) and r[1] == pytest.approx(var, abs=0.1 + 0.1 * var)
        assert r[2] >= max(0, drawn - total + n) and r[3] <= min(n, drawn)


# --- 8 ---


def test_quality(spark, docs, empty):
    r = random.Random(2)
    good = [" ".join(r.choice(["the", "of", "house", "river", "walk", "green", "and", "very", "old"]) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(20, 80))) for _ in range(150)]
    bad = [" ".join("BUY!!" if r.random() < 0.7 else "now" for _ in range(r.randint(20, 80))) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(250)] + [(3, None, 1), (None, 1, 0), (9999, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_documents(df, labels).collect()
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1
        assert (x.score >= quality.THRESHOLD) == (x.doc_id < 150)
    assert quality.keep_good(df, labels).count() == 150
    odd = quality.score_documents(docs, labels).collect()
    assert len(odd) == len(corpus()) and all(0 <= x.score <= 1 for x in odd)
    assert quality.score_documents(empty, labels).count() == 0
    assert all(x.score == 0.5 for x in quality.score_documents(df, labels.limit(0)).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns


def brute_statistics(text: str | None) -> list[float]:
    text = text or ""
    data, found = text.encode(), SPACED.findall(text)
    n = len(found)
    folded = [w.translate(LOWER) for w in found]
    kind = lambda test: sum(map(test, data))
    upper, lower, digit, wide = (kind(lambda b, r=r: b in r) for r in (range(65, 91), range(97, 123), range(48, 58), range(128, 256)))
    line, space, stop, shout = (kind(lambda b, r=r: b in r) for r in (b"\n", b"\t\x0b\x0c\r ", b".", b"!?"))
    mark = kind(lambda b: b in b",;:'\"-()")
    symbol = len(data) - upper - lower - digit - wide - line - space - stop - shout - mark
    lines = line + 1 if data else 0
    shingles = {tuple(folded[k : k + 5]) for k in range(n - 4)} if n >= 5 else {tuple(folded)} if n else set()
    per = lambda a, b: a / max(b, 1)
    return [
        len(data), n, per(len(data) - space - line, n), per(upper, upper + lower), per(digit, len(data)), per(space, len(data)), per(stop, n), per(shout, n), per(symbol, n), per(mark, n), per(wide, len(data)),
        lines, per(n, lines), per(len(set(folded)), n), per(max((folded.count(w) for w in set(folded)), default=0), n), per(len(shingles), max(n - 4, 1)), per(sum(x == y for x, y in zip(folded, folded[1:])), n),
        per(sum(len(w.encode()) > 24 for w in found), n), per(sum(not re.search(r"[A-Za-z0-9\x80-\U0010ffff]", w) for w in found), n),
    ]


def test_quality_against_brute_force(spark):
    """Statistics by their definitions, the model fitted on those of the labelled rows that count, and its rules applied one by one."""
    r = random.Random(6)
    base = [t for _, t, _ in corpus()[:60] if t is None or len(t) < 20_000]
    texts = [*base, *[" ".join(r.choice(["the", "House", "BUY!!", "now", "é1", "--", "x" * 30, "a.b"]) for _ in range(r.randint(0, 60))) + r.choice(["", ".", "\n\nend?"]) for _ in range(240)]]
    labels = [(i, r.choice([0, 1]) if (t or "").count("BUY") < 3 else 0, None) for i, t in enumerate(texts) if i % 3] + [(7, None, 1), (10, 1, 0), (10, 0, 0), (5000, 1, 1)]
    path = new_path(spark, "test")
    spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, score int, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    own = np.array([brute_statistics(t) for t in texts])
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = sorted((i, y) for i, y, _ in labels if y is not None and not out(i) and i < len(texts))
    model = quality.fit_rules(own[[i for i, _ in rows]], np.array([float(y) for _, y in rows]))
    assert model.rules
    got = {x.doc_id: x for x in QUERIES["op8_quality"](spark, path).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i in range(len(texts)):
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all((own[i][f] > t) == above for f, t, above in rule))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
        assert (got[i].held_out, got[i].predicted) == (out(i), int(got[i].score >= 0.3))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = quality.keep_good(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i in got if got[i].predicted) and kept.columns == docs.columns


def test_column_scores_as_the_model():
    from glyphmill.llm.quality import RuleEnsemble, fit_rules

    r = np.random.default_rng(0)
    x = r.random((400, len(quality.STATISTICS)))
    model = fit_rules(x, ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float))
    assert isinstance(model, RuleEnsemble) and 0 < len(model.rules) < 200
    assert ((model.score(x) > 0.5) == ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7))).mean() > 0.97


# --- 9 ---


def test_warc(spark):
    pages = [(1, "http://a b/", "<p>WARC/1.1\r\n\r\nfoo"), (2, None, None), (3, "http://x/", ""), (4, "http://y", "é\r\n\r\n"), (5, "http://z", "é\r\n\r\n"), (6, "q", "<p>WARC/1.1\r\n\r\nfoo"), (7, "q", "x" * 300_000 + "\n1 2 3\n"), (6, "q", "<p>WARC/1.1\r\n\r\nfoo")]
    path = new_path(spark, "test")
    warc_convert.archive_pages(spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload string").repartition(3), path)
    best: dict = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), i)
    want = [(str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if best[h or ""] == i else ("revisit", str(best[h or ""])))) for i, _, h in pages]
    got = [tuple(r) for r in warc_convert.read_warcs(spark, path, "part-*").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    nothing = new_path(spark, "test")
    warc_convert.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), nothing)
    assert warc_convert.read_warcs(spark, nothing, "part-*").count() == 0


def test_arc_versions_by_their_lengths():
    body = "1 0 x\n" + warc_convert.FIELDS[1] + "\n"
    inner = "ab\nhttp://b 1.1.1.1 20210203040506 text/html 3\nxyz"
    one = f"filedesc://f 0.0.0.0 20200101000000 text/plain {len(body)}\n{body}\nhttp://a 1.1.1.1 20210203040506 text/html {len(inner)}\n{inner}\nhttp://c 1.1.1.1 20210203040506 text/html 0\n\n"
    got = list(warc_convert.parse_arc(one.encode()))
    assert [(d["url"], d["block"].decode()) for d in got] == [("http://a", inner), ("http://c", "")]
    with pytest.raises(ValueError):
        list(warc_convert.parse_arc(b"http://a 1.1.1.1 2 text/html 5\nabcde\n"))
    with pytest.raises(ValueError):
        list(warc_convert.parse_arc(one.encode()[:-70]))


def test_op9_query(spark):
    pages = [(i, f"http://h{i % 3}/", "<p>" + "ab" * (i % 4)) for i in range(40)] + [(41, None, None), (42, "u", ""), (43, "v", "é" * 700_000), (3, "http://h0/", "<p>" + "ab" * 3)]
    path = new_path(spark, "test")
    spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, record_type string").write.parquet(f"{path}/pages.parquet")
    best: dict = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), i)
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if best[h or ""] == i else ("revisit", best[h or ""]))) for i, _, h in pages]
    got = QUERIES["op9_warc"](spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_foreign_archives(spark, monkeypatch):
    """An ARC not written here, with a Latin-1 page, a picture, a repeated page, a name server's answer and a page of over 16 MB; then a WARC without headers of ours."""
    import gzip
    import os

    png = b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 3
    http = lambda kind, body: b"HTTP/1.0 200 OK\nServer: caf\xe9\nContent-Type: " + kind + b"\n\n" + body
    big = os.urandom(1000) * 17_000
    docs = [("http://a/", "text/html", http(b"text/html", b"<p>caf\xe9 \xff")), ("http://b/x y.png", "image/png", http(b"image/png", png)), ("http://c/", "text/html", http(b"text/html", b"<p>caf\xe9 \xff")), ("dns:a", "text/dns", b"20200101\na. 1 IN A 1.2.3.4\n"), ("http://d/", "text/html", b"HTTP/1.1 204 No\r\n\r\n"), ("http://e/", "x/y", http(b"x/y", big))]
    about = b"1 0 Other\nURL IP-address Archive-date Content-type Archive-length\n"
    records = [f"filedesc://o.arc 0.0.0.0 20080430 text/plain {len(about)}\n".encode() + about] + [f"{u} 1.2.3.4 20080430204825 {k} {len(b)}\n".encode() + b for u, k, b in docs]
    path = new_path(spark, "test").removeprefix("file://")
    os.makedirs(f"{path}/in")
    with open(f"{path}/in/o.arc.gz", "wb") as f:
        for r in records:
            f.write(gzip.compress(r + b"\n"))
    monkeypatch.setattr(warc_convert, "FILE_RECORDS", 3)
    warc_convert.convert_arcs(spark, f"file://{path}/in", f"file://{path}/out")
    files = [f"{path}/out/{x}" for x in sorted(os.listdir(f"{path}/out")) if x.startswith("part-")]
    seen = []
    for name in files:
        data = open(name, "rb").read()
        own = list(warc_convert.parse_warc(data))
        assert own[0][0]["warc-type"] == "warcinfo" and len(own) <= 3
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(own)
        seen += [(h["warc-target-uri"], h["warc-type"], b) for h, b in own[1:]]
        assert all(h["warc-date"] == "2008-04-30T20:48:25Z" for h, _ in own[1:])
    blocks = {u: (k, b) for u, k, b in seen}
    assert blocks["http://b/x y.png"] == ("response", docs[1][2]) and blocks["dns:a"] == ("resource", docs[3][2]) and blocks["http://e/"] == ("response", docs[5][2])
    assert sorted((blocks["http://a/"][0], blocks["http://c/"][0])) == ["response", "revisit"]
    got = {r.target_uri: r for r in warc_convert.read_warcs(spark, f"file://{path}/out", "part-*").collect()}
    assert len(got) == 6 and len({r.id for r in got.values()}) == 6
    assert {r.payload_digest for u, r in got.items() if u in ("http://a/", "http://c/")} == {warc_convert.sha1_base32(b"<p>caf\xe9 \xff")}
    assert got["http://a/"].payload_bytes == got["http://c/"].payload_bytes == 9 and got["http://d/"].payload_bytes == 0
    os.makedirs(f"{path}/foreign")
    body = http(b"text/html", b"\xe9")
    plain = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:x:{}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://f/\r\nContent-Length: {}\r\n\r\n"
    with open(f"{path}/foreign/a.warc", "wb") as f:
        for n, (kind, block) in enumerate((("warcinfo", b"x: y"), ("request", b"GET"), ("response", body), ("revisit", b""), ("resource", png))):
            f.write(plain.format(kind, n, len(block)).encode() + block + b"\r\n\r\n")
    got = sorted((r.record_id, r.id, r.payload_bytes, r.payload_digest) for r in warc_convert.read_warcs(spark, f"file://{path}/foreign").collect())
    assert got == [("<urn:x:2>", None, 1, warc_convert.sha1_base32(b"\xe9")), ("<urn:x:3>", None, None, None), ("<urn:x:4>", None, len(png), warc_convert.sha1_base32(png))]


# --- 10 ---


def test_licenses(spark, empty):
    texts = ["Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\nunder the mit\nlicense", "This is under the MIT  license and CC BY NC", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License", "mit license under the", None, "", "under the MIT License " * 3, "all rights reserved", "rights all"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = words(ALNUM, t)
        places = sorted((k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert sorted((f["start"], f["label"]) for f in got[i].found if f["phrase"]) == places
        assert got[i].n_words == len(w)
        blocks = sorted((f["label"], round(f["containment"], 6)) for f in got[i].found if not f["phrase"])
        want = []
        for template, label in license_scan.TEMPLATES:
            own = set(template.split())
            parts = re.split(r"\n\n+", t or "") if len(own) > license_scan.LONG else (t or "").split("\n")
            want += [(label, round(len(own & set(words(ALNUM, p))) / len(own), 6)) for p in parts if len(own & set(words(ALNUM, p))) >= license_scan.CONTAINMENT * len(own) - 1e-9]
        assert blocks == sorted(want)
    assert license_scan.scan_licenses(empty).count() == 0


def test_wrapped_notices(spark):
    texts = [
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */", "words\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International\nLicense.\nwords",
        "This is free and unencumbered software\nreleased into the public domain.", "all rights\n\nreserved", "all\nof " + "filler " * 20 + "rights\nreserved", "all rights reserved\nall rights\nreserved", "This work is licensed under the GNU General\nPublic License version 3",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(f["start"], f["end"], f["label"]) for f in r.found] for r in license_scan.scan_licenses(df).collect()}
    assert got[0] == [(0, 26, "mpl-2")] and got[2] == [(0, 11, "unlicense")] and got[6] == [(0, 12, "gpl-3")]
    assert (1, 14, "cc-by-sa") in got[1]
    assert got[3] == got[4] == []  # another paragraph; scattered
    assert sorted(got[5]) == [(0, 3, "all-rights-reserved"), (3, 6, "all-rights-reserved")]


@pytest.mark.parametrize("blank", ["\n\n", "\r\n\r\n", "\n \t\n", "\n\n\n", "\n\u000b\n"])
def test_paragraphs_end_at_lines_of_space(spark, blank):
    """Words of a long template, one in a paragraph, are not that template, whatever the blank lines are made of."""
    text, label = max(license_scan.TEMPLATES, key=lambda t: len(set(t[0].split())))
    assert len(set(text.split())) > license_scan.LONG
    own = text.split()
    df = spark.createDataFrame([(0, blank.join(own)), (1, " ".join(own)), (2, "x\n" + " ".join(own) + blank + "y")], "doc_id bigint, text string")
    got = {r.doc_id: {f["label"] for f in r.found} for r in license_scan.scan_licenses(df).collect()}
    assert label not in got[0] and label in got[1] and label in got[2]


# --- queries ---


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_op10_query(spark):
    """The base columns by their definitions, on a table with clashing names, repeated rows, a null and a very long text."""
    r = random.Random(1)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x", "Y", "é"]
    texts = [None, "", "...", "Under THE mit License", "cc-by-nc; cc by nc", "under the mit\nlicense " * 3] + [" ".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(60)] + [" ".join(r.choice(pool) for _ in range(60_000))]
    rows = [(i, t, "l", 1, "f") for i, t in enumerate(texts)]
    path = new_path(spark, "test")
    spark.createDataFrame([*rows, rows[5]], "doc_id bigint, text string, labels string, n_words int, found string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = QUERIES["op10_license_scan"](spark, path).collect()
    assert sorted(x.doc_id for x in got) == sorted([*range(len(texts)), 5])
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for x in got:
        w = words(ALNUM, texts[x.doc_id])
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels = sorted({label for _, label in places})
        assert (x.n_words, x.n_base) == (len(w), len(places))
        assert (x.first_word, x.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x.base_labels == ",".join(labels) and set(labels) <= set(x.labels.split(",")) | {""}
        assert x.labels == ",".join(sorted(set(x.labels.split(",")))) and 0 <= x.score <= 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert got.columns[0] in ("doc_id", "page_id", "vec_id")
    assert got.count() > 0
