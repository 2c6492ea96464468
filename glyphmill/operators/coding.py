"""Codes: compressed size, messages carried by a text's choices, markup played back."""

from __future__ import annotations

import lzma
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.keyed import Draws


def compressed_size(documents: DataFrame) -> DataFrame:
    """Bits a character that each page takes compressed by itself; means by language."""

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 8 * len(lzma.compress(t.encode(), format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9}])) / max(len(t), 1) if t else 0.0)

    return documents.where("text is not null").select("lang", bits("text").alias("bits")).groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("bits"), 6).alias("bits"))


class Coder:
    """Arithmetic coding in whole numbers of 32 bits over tables of counts."""

    FULL, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30

    @staticmethod
    def narrow(low: int, high: int, counts: list[int], k: int) -> tuple[int, int]:
        span, total, below = high - low + 1, sum(counts), sum(counts[:k])
        return low + span * below // total, low + span * (below + counts[k]) // total - 1

    @classmethod
    def choices(cls, bits: list[int], tables, most: int) -> list[int]:
        """The choices that bits make: tables(choices so far) gives counts. Ends a word after all bits are told, so that none is open; a bit behind them keeps the rest off their edge."""
        bits = [*bits, 1]
        low, high, at, out = 0, cls.FULL, 32, []
        code = int("".join(map(str, (bits + [0] * 32)[:32])), 2)
        told = 0
        while told < len(bits) + 32 and len(out) < most:
            counts = tables(out)
            span, total = high - low + 1, sum(counts)
            x = ((code - low + 1) * total - 1) // span
            k = 0
            while x >= counts[k]:
                x -= counts[k]
                k += 1
            low, high = cls.narrow(low, high, counts, k)
            out.append(k)
            while high < cls.HALF or low >= cls.HALF or (low >= cls.QUARTER and high < 3 * cls.QUARTER):
                off = 0 if high < cls.HALF else cls.HALF if low >= cls.HALF else cls.QUARTER
                told += 1
                low, high = (low - off) * 2, (high - off) * 2 + 1
                code = (code - off) * 2 + (bits[at] if at < len(bits) else 0)
                at += 1
        return out

    @classmethod
    def bits(cls, choices: list[int], tables) -> list[int]:
        """The bits that choices tell."""
        low, high, held, out = 0, cls.FULL, 0, []

        def put(b: int) -> None:
            nonlocal held
            out.extend([b] + [1 - b] * held)
            held = 0

        done: list[int] = []
        for k in choices:
            low, high = cls.narrow(low, high, tables(done), k)
            done.append(k)
            while True:
                if high < cls.HALF:
                    put(0)
                    off = 0
                elif low >= cls.HALF:
                    put(1)
                    off = cls.HALF
                elif low >= cls.QUARTER and high < 3 * cls.QUARTER:
                    held += 1
                    off = cls.QUARTER
                else:
                    break
                low, high = (low - off) * 2, (high - off) * 2 + 1
        held += 1
        put(0 if low < cls.QUARTER else 1)
        return out


def message_round_trip(tk: DataFrame, messages: int = 5, length: int = 256) -> DataFrame:
    """Messages of bits carried by letters drawn from a language's pairs, and read back: wrong bits (none), and bits a letter."""
    pairs = tk.select("lang", F.explode(F.expr("transform(sequence(1, length(tok) + 1), i -> substr(concat('^', tok, '$'), i, 2))")).alias("p")).groupBy("lang", "p").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        abc = "".join(sorted({c for p in pdf.p for c in p} - {"^", "$"})) + "$"
        counts = {p: int(n) for p, n in zip(pdf.p, pdf.n)}
        rows = {a: [1 + counts.get(a + b, 0) * 4000 // max(counts.values()) for b in abc] for a in "^" + abc[:-1]}
        tables = lambda done: rows["^" if not done or abc[done[-1]] == "$" else abc[done[-1]]]
        wrong = letters = 0
        for k in range(messages):
            d = Draws("message", pdf.lang.iloc[0], k)
            bits = [int(d.uniform() < 0.5) for _ in range(length)]
            text = Coder.choices(bits, tables, 40 * length)
            back = Coder.bits(text, tables)
            wrong += sum(x != y for x, y in zip(bits, back)) + max(0, len(bits) - len(back))
            letters += len(text)
        return pd.DataFrame([(pdf.lang.iloc[0], messages, wrong, round(messages * length / letters, 6))], columns=["lang", "messages", "wrong", "bits_per_letter"])

    return pairs.groupBy("lang").applyInPandas(run, "lang string, messages long, wrong long, bits_per_letter double")


#: Words in comments that mark a scribe's change.
CHANGES = r"corr|eras|above|inser|added"


_MARKUP = re.compile(r"<!(?P<note>[^>]*)>?|<(?P<gap>[-~])>|<[^>]*>?|\[(?P<first>[^\]:]*)[^\]]*\]?|\{[^}]*\}?|(?P<rare>@\d+;)|(?P<stop>\.)|[,!\s]|(?P<letter>.)")


def replay(raw: str) -> list[tuple[int, int, str]]:
    """Changes that comments of a marked-up line tell of: word, place in the word, and comment. Stops and gaps part words, commas and blanks don't; a rare sign is one letter."""
    events, word, place = [], 0, 0
    for m in _MARKUP.finditer(raw):
        if m["note"] is not None and re.search(CHANGES, m["note"], re.I):
            events.append((word, place, m["note"]))
        elif m["first"] is not None:
            place += len(re.sub(r"@\d+;", "*", re.sub(r"\{[^}]*\}", "", m["first"])))
        elif m["rare"] or m["letter"]:
            place += 1
        elif (m["stop"] or m["gap"]) and place:
            word, place = word + 1, 0
    return events


def markup_edits(ln: DataFrame) -> DataFrame:
    """Lines written with markup, cleaned by expressions and played back by the kernel: words agree, and every change is met."""
    from glyphmill.sources.transliteration import clean_words

    noted = F.transform("words", lambda w, i: F.when(F.crc32(w.cast("binary")) % 7 == 0, F.concat(w, F.lit("<!Corrected>"))).when(F.crc32(w.cast("binary")) % 7 == 2, F.concat(F.lit(" "), w, F.lit(",! "))).when(F.crc32(w.cast("binary")) % 7 == 1, F.concat(F.lit("["), F.substring(w, 1, 1), F.lit(":x]"), w.substr(F.lit(2), F.length(w)))).otherwise(w))
    raw = ln.where("size(words) > 0").select("lang", "words", F.concat(F.array_join(noted, "."), F.lit("<$>")).alias("raw"))

    @F.pandas_udf("long")
    def changes(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: len(replay(r)))

    out = raw.select("lang", (clean_words(F.col("raw"), commas_part=False) == F.col("words")).cast("double").alias("agree"), changes("raw").alias("changes"), F.size(F.filter("words", lambda w: F.crc32(w.cast("binary")) % 7 == 0)).alias("due"))
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("agree"), 6).alias("agree"), F.sum("changes").alias("changes"), F.sum("due").cast("bigint").alias("due"))
