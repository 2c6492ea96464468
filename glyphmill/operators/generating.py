"""Texts in the layout of a corpus, page by page. What a page holds depends on its id and the model alone."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.keyed import Draws, drawn

#: Rows of a model that may be sent to all executors; a larger model is refused.
MODEL_ROWS = 500_000
_LINES = "lang string, doc_id long, line_no long, text string"


def _layout(tk: DataFrame) -> DataFrame:
    return tk.groupBy("lang", "doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("tok")).alias("letters"))


def _small(model: DataFrame) -> pd.DataFrame:
    rows = model.limit(MODEL_ROWS + 1).toPandas()
    if len(rows) > MODEL_ROWS:
        raise ValueError(f"the model has more than {MODEL_ROWS} rows; prune it first")
    return rows


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["lang", "doc_id", "line_no", "text"])


def _frequent(tk: DataFrame, words: int) -> dict[str, tuple[list[str], list[float]]]:
    ranked = tk.groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n")).selectExpr("lang", "tok", "n", "row_number() over (partition by lang order by n desc, tok) as r").where(f"r <= {words}")
    return {lang: (g.sort_values("r").tok.tolist(), g.sort_values("r").n.astype(float).tolist()) for lang, g in _small(ranked).groupby("lang")}


def automaton_text(tk: DataFrame, order: int = 2) -> DataFrame:
    """Letters drawn given the ones before, line by line to the line's length: no end before 60 % of it, an end at 140 % at the latest."""
    tables = _letter_tables(tk, order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values("line_no").itertuples():
            d, words, size = Draws("automaton", r.doc_id, r.line_no), [], 0
            while size < 0.6 * r.letters or (size < 1.4 * r.letters and len(words) < r.n):
                word, ctx = "", "^" * order
                while len(word) < 20:
                    found = tables.get((r.lang, ctx))
                    c = found[0][d.pick(found[1])] if found else "$"
                    if c == "$":
                        break
                    word, ctx = word + c, (ctx + c)[-order:]
                if not word:
                    break
                words.append(word)
                size += len(word)
            rows.append((r.lang, r.doc_id, r.line_no, " ".join(words)))
        return _frame(rows)

    return _layout(tk).groupBy("doc_id").applyInPandas(run, _LINES)


#: Letters that stand for each other in a changed copy.
SIMILAR = {"a": "o", "o": "a", "e": "i", "i": "e", "n": "m", "m": "n", "t": "d", "d": "t", "s": "r", "r": "s"}


def copied_text(tk: DataFrame, seeds: int = 50) -> DataFrame:
    """Words copied with small changes: six in ten from the line above or beside it, two from the word before, else from the page, or a seed word."""
    frequent = _frequent(tk, seeds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        page, above, rows, d = [], [], [], Draws("copy", pdf.doc_id.iloc[0])
        for r in pdf.sort_values("line_no").itertuples():
            line: list[str] = []
            for j in range(r.n):
                x, source = d.uniform(), ""
                if x < 0.6 and above:
                    source = above[min(len(above) - 1, max(0, j + d.below(3) - 1))]
                elif x < 0.8 and line:
                    source = line[-1]
                elif x < 0.95 and page:
                    source = page[d.below(len(page))]
                else:
                    words, weights = frequent[r.lang]
                    source = words[d.pick(weights)]
                if d.uniform() >= 0.15:
                    k = d.below(len(source))
                    y = d.uniform()
                    if y < 0.6:
                        source = source[:k] + SIMILAR.get(source[k], source[k]) + source[k + 1 :]
                    elif y < 0.8 and len(source) > 2:
                        source = source[:k] + source[k + 1 :]
                    else:
                        source = source + "s"
                line.append(source[:16])
            page += line
            above = line
            rows.append((r.lang, r.doc_id, r.line_no, " ".join(line)))
        return _frame(rows)

    return _layout(tk).groupBy("doc_id").applyInPandas(run, _LINES)


def recency_text(tk: DataFrame, repeat: float = 0.08, reach: int = 8, words: int = 500) -> DataFrame:
    """Words drawn from a language's frequencies, but for some that come again from the last few with a decaying weight."""
    frequent = _frequent(tk, words)
    fall = [0.8**k for k in range(reach)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        history, rows, d = [], [], Draws("recency", pdf.doc_id.iloc[0])
        for r in pdf.sort_values("line_no").itertuples():
            line = []
            for _ in range(r.n):
                if len(history) >= reach and d.uniform() < repeat:
                    word = history[-1 - d.pick(fall)]
                else:
                    choice, weights = frequent[r.lang]
                    word = choice[d.pick(weights)]
                line.append(word)
                history = [*history[-reach:], word]
            rows.append((r.lang, r.doc_id, r.line_no, " ".join(line)))
        return _frame(rows)

    return _layout(tk).groupBy("doc_id").applyInPandas(run, _LINES)


def wrapped_text(tk: DataFrame, width: int = 55, lines: int = 30) -> DataFrame:
    """A page's words in order, wrapped anew at a width, and in pages of so many lines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, now = [], []
        for w in [*pdf.sort_values(["line_no", "pos"]).tok, None]:
            if w is None or (now and len(" ".join(now)) + 1 + len(w) > width):
                rows.append((pdf.lang.iloc[0], pdf.doc_id.iloc[0], len(rows) // lines, len(rows) % lines, " ".join(now)))
                now = []
            if w is not None:
                now.append(w)
        return pd.DataFrame(rows, columns=["lang", "doc_id", "page", "line_no", "text"])

    return tk.select("lang", "doc_id", "line_no", "pos", "tok").groupBy("doc_id").applyInPandas(run, "lang string, doc_id long, page long, line_no long, text string")


def autokey_text(ln: DataFrame, key: str = "quill") -> DataFrame:
    """Lines enciphered by their own letters: each a-z letter moves by the one some places before, the first by a key."""

    def line(words) -> str:
        text, out = " ".join(words if words is not None else []), []
        stream = list(key) + [c for c in text if "a" <= c <= "z"]
        k = 0
        for c in text:
            if "a" <= c <= "z":
                out.append(chr((ord(c) + ord(stream[k]) - 2 * 97) % 26 + 97))
                k += 1
            else:
                out.append(c)
        return "".join(out)

    @F.pandas_udf("string")
    def encipher(rows: pd.Series) -> pd.Series:
        return rows.map(line)

    return ln.where("size(words) > 0").select("lang", "doc_id", F.col("line_no").cast("bigint").alias("line_no"), encipher("words").alias("text"))


#: Codes of letters that a worker remembers for a table, and blocks of eight draws that a line takes at a time.
KNOWN, AHEAD = 1 << 16, 8
#: Cards of each of six tables in the deck, single letters in 36 draws, joined words in a hundred.
DECK, SINGLE, JOINED = (20, 8, 8, 8, 4, 4), 17, 3


def deck_text(ln: DataFrame) -> DataFrame:
    """Lines enciphered letter by letter or by pairs, each with the table that the next card of a shuffled deck names."""
    deck = [t for t, n in enumerate(DECK) for _ in range(n)]
    syllables = ["o", "ka", "di", "lu", "se", "nor", "tel", "wi", "zu", "pa", "ro", "min", "ha"]

    known: list[dict[str, str]] = [{} for _ in DECK]

    def code(letters: str, table: int) -> str:
        d = Draws("table", table, letters)
        if len(known[table]) >= KNOWN:
            known[table].clear()
        known[table][letters] = syllables[d.below(len(syllables))] + (syllables[d.below(len(syllables))] if len(letters) > 1 else "")
        return known[table][letters]

    def line(words, doc_id: int, line_no: int) -> str:
        text, key, block, out, i = "".join(words), f"deck:{doc_id}:{line_no}", 0, [], 0
        u, k = [], 0
        while i < len(text):
            # a deck takes a draw a card but one to shuffle, then two a piece at most
            while len(u) < k + 3 * len(deck):
                u, k = u[k:] + drawn(key, 8 * AHEAD, block).tolist(), 0
                block += AHEAD
            cards = list(deck)
            for at in range(len(cards) - 1, 0, -1):
                j = int(u[k] * (at + 1))
                cards[at], cards[j] = cards[j], cards[at]
                k += 1
            while cards and i < len(text):
                n = 1 if int(u[k] * 36) < SINGLE else 2
                letters, table = text[i : i + n], cards.pop()
                piece = known[table].get(letters) or code(letters, table)
                if not out:
                    out.append(piece)
                    k += 1
                else:
                    if int(u[k + 1] * 100) >= JOINED:
                        out.append(" ")
                    out.append(piece)
                    k += 2
                i += n
        return "".join(out)

    @F.pandas_udf("string")
    def encipher(words: pd.Series, doc: pd.Series, no: pd.Series) -> pd.Series:
        return pd.Series([line(w if w is not None else [], int(a), int(b)) for w, a, b in zip(words, doc, no)], dtype=object)

    return ln.where("size(words) > 0").select("lang", "doc_id", F.col("line_no").cast("bigint").alias("line_no"), encipher("words", "doc_id", "line_no").alias("text"))


def _letter_tables(tk: DataFrame, order: int) -> dict[tuple[str, str], tuple[list[str], list[float]]]:
    grams = tk.select("lang", F.explode(F.expr(f"transform(sequence(1, length(tok) + 1), i -> substr(concat(repeat('^', {order}), tok, '$'), i, {order + 1}))")).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    tables: dict[tuple[str, str], tuple[list[str], list[float]]] = {}
    for lang, g, n in _small(grams.orderBy("lang", "g")).itertuples(index=False):
        symbols, weights = tables.setdefault((lang, g[:-1]), ([], []))
        symbols.append(g[-1])
        weights.append(float(n))
    return tables


def _normal(*key: object) -> float:
    """A draw from the normal distribution that its key determines: the sum of twelve uniform ones, less six."""
    d = Draws("normal", *key)
    return sum(d.uniform() for _ in range(12)) - 6


def composed_text(
    tk: DataFrame, words: int = 400, repeat: float = 0.0, reach: int = 8, slip: float = 0.0, walk: float = 0.0, tilt: float = 0.0, coin: float = 0.0, own: float = 0.0, edge: bool = False, drift: str = "", other: str = "fr", pages_a_group: int = 10
) -> DataFrame:
    """Words drawn for each place of a layout by a mixture of routes, each of which an option turns on.

    repeat: the share that comes again from the last `reach` words, the nearer the likelier; slip: the share with one
    letter changed, which isn't remembered; walk: how far words' weights wander from one group of pages to the next;
    tilt: how much a line favours the first letters its hash picks; coin: the share made new by a letter automaton, words
    that exist being refused; own: the share from the page's own words; edge: line-final words are chosen among
    candidates by how often their last letter ends lines; drift: `smooth` or `step` from the page's language to `other`.
    """
    frequent = _frequent(tk, words)
    letters = _letter_tables(tk, 2) if coin else {}
    known = {lang: set(w) for lang, (w, _) in frequent.items()}
    last = {lang: dict(zip(g.sym, g.n.astype(float))) for lang, g in _small(tk.where("pos = n_line - 1").groupBy("lang", F.expr("right(tok, 1)").alias("sym")).agg(F.count(F.lit(1)).alias("n"))).groupby("lang")} if edge else {}
    most = tk.agg(F.max("doc_id")).first()[0] or 1
    fall = [0.8**k for k in range(reach)]
    layout = _layout(tk)
    if own:
        layout = layout.join(tk.groupBy("doc_id").agg(F.array_sort(F.collect_set("tok")).alias("page_words")), "doc_id")

    def coined(lang: str, d: Draws) -> str | None:
        for _ in range(20):
            word, ctx = "", "^^"
            while len(word) < 16:
                found = letters.get((lang, ctx))
                c = found[0][d.pick(found[1])] if found else "$"
                if c == "$":
                    break
                word, ctx = word + c, (ctx + c)[-2:]
            if word and word not in known[lang]:
                return word
        return None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, first = int(pdf.doc_id.iloc[0]), pdf.lang.iloc[0]
        d, history, rows = Draws("composed", repeat, slip, walk, tilt, coin, own, edge, drift, doc), [], []
        group = doc // pages_a_group
        models: dict[str, tuple[list[str], list[float]]] = {}
        for lang in {first, other if drift else first} & set(frequent):
            w, n = frequent[lang]
            if walk:  # the sum of steps of the last groups
                n = [x * 2.718281828 ** (walk * sum(_normal(t, g) for g in range(max(0, group - 3), group + 1)) / 2) for t, x in zip(w, n)]
            models[lang] = (w, n)
        far = doc / most if drift == "smooth" else float(doc > most / 2)
        page_words = list(pdf.page_words.iloc[0]) if own else []
        for r in pdf.sort_values("line_no").itertuples():
            line: list[str] = []
            favoured = {c for c in "abcdefghijklmnopqrstuvwxyz" if tilt and Draws("tilt", doc, r.line_no, c).uniform() < 0.3}
            for j in range(r.n):
                lang = other if drift and other in models and d.uniform() < far else first
                w, n = models[lang]
                if len(history) >= reach and repeat and d.uniform() < repeat:
                    word = history[-1 - d.pick(fall)]
                elif coin and d.uniform() < coin:
                    word = coined(lang, d) or w[d.pick(n)]
                elif own and d.uniform() < own:
                    word = page_words[d.below(len(page_words))]
                elif edge and j == r.n - 1:
                    some = [w[d.pick(n)] for _ in range(20)]
                    word = some[d.pick([last[first].get(x[-1], 0.5) for x in some])]
                else:
                    word = w[d.pick(n)]
                    if favoured and word[0] not in favoured and d.uniform() < tilt:
                        word = w[d.pick(n)]
                history = [*history[-reach:], word]
                if slip and d.uniform() < slip:
                    k = d.below(len(word))
                    word = word[:k] + SIMILAR.get(word[k], word[k]) + word[k + 1 :]
                line.append(word)
            rows.append((first, doc, r.line_no, " ".join(line)))
        return _frame(rows)

    return layout.groupBy("doc_id").applyInPandas(run, _LINES)


def grammar_text(tk: DataFrame) -> DataFrame:
    """Recency, slips and chosen line ends over a wandering vocabulary."""
    return composed_text(tk, repeat=0.05, slip=0.02, walk=0.25, edge=True)


def two_route_text(tk: DataFrame) -> DataFrame:
    """Words retrieved from a wandering repertoire, or coined."""
    return composed_text(tk, coin=0.1, slip=0.02, repeat=0.03, walk=0.4)


def page_mixture_text(tk: DataFrame) -> DataFrame:
    return composed_text(tk, own=0.5)


def smooth_drift_text(tk: DataFrame) -> DataFrame:
    return composed_text(tk, drift="smooth")


def step_drift_text(tk: DataFrame) -> DataFrame:
    return composed_text(tk, drift="step")


def tilted_text(tk: DataFrame) -> DataFrame:
    return composed_text(tk, tilt=0.5)


def walking_text(tk: DataFrame) -> DataFrame:
    return composed_text(tk, walk=0.6)


#: Letters of a verbose cipher: what stands for a letter depends on the sign before.
HOMOPHONES = 3


def verbose_text(ln: DataFrame, spaces: str = "nsty") -> DataFrame:
    """Lines enciphered letter by letter with groups of signs, picked by the sign before; then cut behind certain signs."""
    signs = [c + v for c in "kdtlnrs" for v in "aeio"]

    # the sign before is one of few, so letters have few groups each
    groups: dict[str, dict[str, str]] = {}
    cut = re.compile(f"..+?[{re.escape(spaces)}]|.+")

    def group(last: str, c: str) -> str:
        return signs[Draws("verbose", c, Draws("pick", last, c).below(HOMOPHONES)).below(len(signs))] + ("n" if c in "aeiou" else "")

    def line(words) -> str:
        out, last = [], "^"
        for c in "".join(words):
            own = groups.get(last)
            if own is None:
                own = groups[last] = {}
            found = own.get(c)
            if found is None:
                found = own[c] = group(last, c)
            out.append(found)
            last = found[-1]
        return " ".join(cut.findall("".join(out)))

    @F.pandas_udf("string")
    def encipher(rows: pd.Series) -> pd.Series:
        return rows.map(lambda w: line(w if w is not None else []))

    return ln.where("size(words) > 0").select("lang", "doc_id", F.col("line_no").cast("bigint").alias("line_no"), encipher("words").alias("text"))


def twin_residual(tk: DataFrame, least_lines: int = 30) -> DataFrame:
    """How a text and its twin from a letter automaton differ: bits a character compressed, page by page, mean by language."""
    import lzma

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 8 * len(lzma.compress(t.encode(), format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 1}])) / max(len(t), 1))

    def joined(lines: DataFrame, name: str) -> DataFrame:
        return lines.groupBy("lang", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"), F.count(F.lit(1)).alias("lines")).select("lang", "doc_id", "lines", bits("t").alias(name))

    real = tk.groupBy("lang", "doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("text"))
    both = joined(real, "bits").where(f"lines >= {least_lines}").join(joined(automaton_text(tk), "twin_bits").select("doc_id", "twin_bits"), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(F.col("bits") - F.col("twin_bits")), 6).alias("residual"))


#: Controls by name: texts made to have, or to lack, what a test looks for.
CONTROLS = {
    "automaton": automaton_text, "copying": copied_text, "recency": recency_text, "wrapped": wrapped_text, "grammar": grammar_text, "two_routes": two_route_text, "page_mixture": page_mixture_text,
    "smooth_drift": smooth_drift_text, "step_drift": step_drift_text, "tilted": tilted_text, "walking": walking_text,
}


def tuning_sweep(tk: DataFrame, shares: tuple[float, ...] = (0.0, 0.1, 0.2, 0.4)) -> DataFrame:
    """A control at several settings, and the statistic that it is tuned by: shares of words repeated from shortly before, and how often a word of a line stands among the eight before it. One job for all settings."""
    out = None
    for share in shares:
        text = composed_text(tk, repeat=share).select("lang", "doc_id", "line_no", F.split("text", " ").alias("words"))
        words = text.select("lang", F.posexplode("words").alias("pos", "tok"), "words").where("tok <> ''")
        hit = F.array_contains(F.slice("words", F.greatest(F.col("pos") - 7, F.lit(1)), F.least(F.col("pos"), F.lit(8))), F.col("tok"))
        own = words.groupBy("lang").agg(F.round(F.avg(hit.cast("double")), 6).alias("repeated"), F.count(F.lit(1)).alias("n")).select(F.lit(share).alias("share"), "*")
        out = own if out is None else out.union(own)
    return out
