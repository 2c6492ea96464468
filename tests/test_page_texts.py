"""Kernels with a form on arrays of whole pages: the rows of the words' own form, and nothing shuffled but counts."""

from __future__ import annotations

import pytest

from glyphmill.kernels import QUERIES
from glyphmill.operators import cutting, generating
from glyphmill.operators.page_texts import PAGED
from glyphmill.sources.corpus import frames
from tests.compare import rows
from tests.test_pages import VERSE

PAGES = [
    (1, VERSE, "en", "a"), (2, None, "en", "a"), (3, "", "en", "b"), (4, "\n\n\n", "fr", "b"), (5, "one", "fr", "a"), (9, VERSE.upper() + "\n" + VERSE, "en", "a"),
    (8, "\n".join(["a b a c a b a b"] * 40), "fr", None), (7, "été et ça\nÇa et été l'été 12 Œ\n" * 19, "fr", "b"), (900, VERSE.replace("\n", " ") * 9, "en", "b"), (90, VERSE + "\r\n" + VERSE, "en", "c"), (901, "x" * 70 + " 𝔘𝔫 \n\n" + "y" * 30, "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("texts")
    for name, more in (("alone", []), ("twice", [(8, VERSE, "fr", None)])):
        spark.createDataFrame(PAGES + more, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{top}/{name}/documents.parquet")
    return top


def plain(spark, folder, name):
    return getattr(generating if hasattr(generating, name) else cutting, name)(**frames(spark, folder, ("tk",)))


@pytest.mark.parametrize("name", sorted(PAGED))
def test_rows_of_words(spark, sf, odd, name):
    for folder in (str(odd / "alone"), sf):
        found = QUERIES[name](spark, folder)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "posexplode" not in plan
        assert rows(found.toPandas()) == rows(plain(spark, folder, name).toPandas())


def test_pages_of_one_id(spark, odd):
    assert "FlatMapGroupsInPandas" in QUERIES["recency_text"](spark, str(odd / "twice"))._jdf.queryExecution().toString()


def enciphered(monkeypatch, name, *columns):
    """Texts that a cipher's UDF gives for columns, and how many streams of draws it began."""
    import pandas as pd

    found, begun = [], []

    class Functions:
        def pandas_udf(self, kind):
            return lambda f: found.append(f) or (lambda *names: self)

        def __getattr__(self, name):
            return lambda *x: self

    class Counted(generating.Draws):
        def __init__(self, *key):
            begun.append(key)
            super().__init__(*key)

    monkeypatch.setattr(generating, "F", Functions())
    monkeypatch.setattr(generating, "Draws", Counted)
    getattr(generating, name)(Functions())
    return list(found[0](*(pd.Series(c) for c in columns))), len(begun)


LINES = [["the", "old", "mill"], ["été", "x" * 90], ["n"], []] * 200


def test_verbose_cipher_draws_once_a_sign(monkeypatch):
    draws, signs, spaces = generating.Draws, [c + v for c in "kdtlnrs" for v in "aeio"], "nsty"

    def plain(words):
        out, last = "", "^"
        for c in "".join(words):
            out += signs[draws("verbose", c, draws("pick", last, c).below(3)).below(28)] + ("n" if c in "aeiou" else "")
            last = out[-1]
        piece, pieces = "", []
        for c in out:
            piece += c
            if c in spaces and len(piece) >= 3:
                pieces.append(piece)
                piece = ""
        return " ".join([*pieces, piece] if piece else pieces)

    found, begun = enciphered(monkeypatch, "verbose_text", LINES)
    assert found == [plain(x) for x in LINES] and begun < 500


def test_deck_cipher_draws_once_a_code(monkeypatch):
    draws, syllables = generating.Draws, ["o", "ka", "di", "lu", "se", "nor", "tel", "wi", "zu", "pa", "ro", "min", "ha"]

    def plain(words, doc_id, line_no):
        text, d = "".join(words), draws("deck", doc_id, line_no)
        cards, out, i = [], [], 0
        while i < len(text):
            cards = cards or d.shuffled([t for t, n in enumerate(generating.DECK) for _ in range(n)])
            n, e = 1 if d.below(36) < generating.SINGLE else 2, draws("table", cards.pop(), text[i : i + 2])
            if n == 1:
                e = draws(*e.key.decode().split(":")[:2], text[i])
            piece = syllables[e.below(13)] + (syllables[e.below(13)] if len(text[i : i + n]) > 1 else "")
            if out and d.below(100) < generating.JOINED:
                out[-1] += piece
            else:
                out.append(piece)
            i += n
        return " ".join(out)

    docs, numbers = [k // 7 for k in range(len(LINES))], [k % 7 for k in range(len(LINES))]
    found, begun = enciphered(monkeypatch, "deck_text", LINES, docs, numbers)
    assert found == [plain(*x) for x in zip(LINES, docs, numbers, strict=True)] and begun < 500
