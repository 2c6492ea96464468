"""Plans with a form on arrays of whole pages: no row for a word, and the rows of the SQL for odd pages too."""

from __future__ import annotations

from pathlib import Path

import pytest

from glyphmill import plans
from glyphmill.operators import run_tables
from glyphmill.operators import pages as pages_module
from glyphmill.operators.pages import PAGED
from tests.compare import rows

VERSE = "the old mill\n\nstood by the old mill and the old stream\nthe old mill and the stream, by the mill\n the mill stood\nold ÉTÉ été x\nthe old stream by the old mill stood and stood"
PAGES = [
    (1, VERSE, "en", "a"), (2, None, "en", "a"), (3, "", "en", "b"), (4, "\n\n\n", "fr", "b"), (5, "one", "fr", "a"), (9, VERSE.upper() + "\n" + VERSE, None, "a"),
    (8, "\n".join(["a b a c a b a b"] * 20), "fr", None), (7, "été et ça\nÇa et été l'été 12 Œ\n" * 9, "fr", "b"), (900, VERSE.replace("\n", " "), "en", "b"), (90, VERSE + "\r\n" + VERSE, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    for name, more in (("alone", []), ("twice", [(8, VERSE, "fr", None), (None, VERSE, "en", "a")])):
        spark.createDataFrame(PAGES + more, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{top}/{name}/documents.parquet")
    return top


def theirs(path, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    return con.sql(plans.duck_text(name)).df()


@pytest.mark.parametrize("name", sorted(PAGED))
def test_no_row_for_a_word(spark, odd, name):
    plan = run_tables(spark, str(odd / "alone"), name)._jdf.queryExecution().toString()
    assert ("MapInArrow" in plan or "ExistingRDD" in plan) and "Window" not in plan and "posexplode" not in plan


@pytest.mark.parametrize("name", sorted(PAGED))
def test_odd_pages(spark, odd, name):
    assert rows(run_tables(spark, str(odd / "alone"), name).toPandas()) == rows(theirs(odd / "alone", name))


def test_pages_of_one_id_are_left_to_sql(spark, odd):
    assert "MapInArrow" not in run_tables(spark, str(odd / "twice"), "e4_line_drift")._jdf.queryExecution().toString()


def test_digests():
    import hashlib

    import numpy as np

    from glyphmill.operators.hashing import by_digest, digests

    for keys in ([b"", b"a" * 55], [b"s%d:%d" % (i % 5, i) for i in range(9000)], [b"a" * 56]):
        assert [f"{a:016x}{b:016x}" for a, b in digests(np.array(keys)).tolist()] == [hashlib.md5(k).hexdigest() for k in keys]
    keys = np.array([b"x", b"y", b"z", b"y", b"w"])
    assert keys[by_digest(keys, np.array([0, 0, 0, 1, 1]))].tolist() == [*sorted([b"x", b"y", b"z"], key=lambda k: hashlib.md5(k).digest()), *sorted([b"y", b"w"], key=lambda k: hashlib.md5(k).digest())]


def test_edit_distances():
    import numpy as np

    from glyphmill.operators.distances import Edits

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, e in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    rng = np.random.default_rng(2)
    for letters in ("abcdé", [chr(k) for k in range(97, 900)]):
        words = ["".join(rng.choice(list(letters), size=int(n))) for n in rng.integers(0, 19, 90)] + ["", "abc" * 21 + "a", "abd" * 22, "x" * 200, "\U0001d400a"]
        x, y = (k.ravel() for k in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
        assert Edits(words).of(x, y).tolist() == [plain(words[a], words[b]) for a, b in zip(x, y, strict=True)]
    none = np.zeros(0, dtype=np.int64)
    assert not len(Edits([]).of(none, none))


@pytest.mark.parametrize("name", ["hellinger", "jsd_by_relation", "page_jsd_matrix"])
def test_pairs_of_blocks(spark, tmp_path, monkeypatch, name):
    """Several blocks of a source, rare letters, pages without a letter in common, nulls."""
    import random

    from glyphmill.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 4)
    r = random.Random(4)
    kinds = ["abcde", "abcxyzéœ", "αβγδ", "abcdeж"]
    pages = [(k * 7 - 40, " ".join(r.choices(r.choice(kinds), k=r.choice([199, 200, 340]))) + " q" * (k == 5), r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None])) for k in range(60)]
    spark.createDataFrame(pages, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = run_tables(spark, str(tmp_path), name)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    assert rows(found.toPandas()) == rows(theirs(tmp_path, name))


def test_matrix_is_written_small(spark, tmp_path):
    """Ids of pairs take next to no room, and the session's own settings of the writer stay."""
    import random

    import pyarrow.parquet as pq

    r = random.Random(5)
    pages = [(k * 3 + r.randrange(3), " ".join(r.choices("abcdefgh", k=200 + k)), "en", "a") for k in range(400)]
    spark.createDataFrame(pages, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    keys = [*pages_module.WRITTEN, "spark.sql.parquet.compression.codec"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for codec in (None, "gzip"):
            for k in keys:
                spark.conf.unset(k)
            if codec:
                spark.conf.set("spark.sql.parquet.compression.codec", codec)
            run_tables(spark, str(tmp_path), "page_jsd_matrix").write.parquet(out := f"{tmp_path}/out_{codec}")
            groups = [g.row_group(k) for p in Path(out).glob("*.parquet") for g in [pq.ParquetFile(p).metadata] for k in range(g.num_row_groups)]
            columns = [g.column(k) for g in groups for k in range(4)]
            assert {c.compression for c in columns if c.num_values} == {(codec or "zstd").upper()}
            assert sum(g.num_rows for g in groups) == 400 * 399 // 2
            assert sum(c.total_compressed_size for c in columns if c.path_in_schema in ("i", "j")) < 0.25 * 400 * 399 // 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("ids", ["alone", "twice"])
def test_devices_draw_from_all_words(spark, tmp_path, monkeypatch, ids):
    """Words beyond the 200 most frequent are drawn too, in lists of several parts, as counts of all words ask; languages of fewer than ten words, and nulls."""
    import random

    monkeypatch.setattr(pages_module, "PART_TOKENS", 700)
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghiéœ", k=5)) for _ in range(900)]
    text = lambda: "\n".join(" ".join(r.choices(words[:400], k=9) + r.choices(words, k=4) + ["zz"]) for _ in range(20))
    pages = [(k, text(), r.choice(["en", "en", "fr", None]), "a") for k in range(40)] + [(90, "un deux trois un deux un\n" * 9, "few", "a"), (91, None, "en", "a"), (92, "", "none", "a")]
    spark.createDataFrame(pages + pages[:1] * (ids == "twice"), "doc_id bigint, text string, lang string, source string").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = run_tables(spark, str(tmp_path), "device_text").toPandas()
    assert rows(found) == rows(theirs(tmp_path, "device_text"))
    total = 14 * 20 * sum(p[2] == "en" for p in pages + pages[:1] * (ids == "twice") if p[1])
    assert found[found.lang == "en"].n.sum() == total and found[found.lang == "en"].tok.nunique() > 500
    assert set(found[found.lang == "few"].phase) == {1, 2, 3, 4} and "none" not in set(found.lang)


def test_rounds_as_sql(spark):
    import numpy as np

    x = np.array([0.0000005, 0.1234565, 0.9999995, 0.0, -1e-17, 0.3333335, 0.0000015, 0.2500005, 1.0, *np.random.default_rng(1).random(2000)])
    found = spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("round(x, 6) as r").toPandas()["r"]
    assert pages_module._rounded(x).tolist() == found.tolist()
