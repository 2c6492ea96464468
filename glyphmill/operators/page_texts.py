"""Kernels on arrays of whole pages: the lines of operators/generating.py, made where pages lie, and packed lines.

Only the counts of types, from which models come, are shuffled. Draws are those of the same keys, taken many at once.
"""

from __future__ import annotations

import lzma
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.generating import _LINES, SIMILAR, _small
from glyphmill.operators.keyed import Draws, drawn, seeded
from glyphmill.operators.pages import Pages, over_pages, types_of
from glyphmill.sources.corpus import WORD

_SCHEMA = _LINES.replace("long", "bigint")


class Lines:
    """Lines that have words: page, number in it, words and letters; pages that have such lines, and where their lines and words begin and end."""

    def __init__(self, p: Pages):
        at = np.flatnonzero(p.count)
        self.page, self.no, self.n = p.page[p.first[at]], p.line[p.first[at]], p.count[at]
        self.letters = np.bincount(p.at, np.array([len(w) for w in p.words] or [0])[p.word], p.room).astype(np.int64)[at]
        self.upto = np.concatenate([[0], np.cumsum(self.n)])
        self.pages, first = np.unique(self.page, return_index=True)
        ends = np.append(first, len(at))
        self.lines, words = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), self.upto[ends]
        self.words = list(zip(words[:-1].tolist(), words[1:].tolist(), strict=True))


def _langs(p: Pages, page: np.ndarray) -> pa.Array:
    return pa.array(p.names, pa.string()).take(pa.array(p.lang_of[page]))


def _rows(p: Pages, lines: Lines, text: pa.Array) -> list:
    return [_langs(p, lines.page), pa.array(p.ids[lines.page]), pa.array(lines.no), text]


def _joined(words: pa.Array, codes: np.ndarray, upto: np.ndarray) -> pa.Array:
    """Lines of words, which are places in a list."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.take(pa.array(codes))), " ")


class Frequent:
    """The most frequent words of languages in one list, and how their counts add up."""

    def __init__(self, docs: DataFrame, words: int):
        ranked = types_of(docs).selectExpr("lang", "tok", "n", "row_number() over (partition by lang order by n desc, tok) as r").where(f"r <= {words}")
        found: dict[str | None, list[tuple[int, str, float]]] = {}
        for lang, tok, n, r in _small(ranked).itertuples(index=False):
            found.setdefault(lang, []).append((r, tok, float(n)))
        self.words: list[str] = []
        self.base, self.ends = {}, {}
        for lang, rows in found.items():
            self.base[lang], self.ends[lang] = len(self.words), np.cumsum([n for _, _, n in sorted(rows)])
            self.words += [tok for _, tok, _ in sorted(rows)]

    def pick(self, lang: str | None, u: np.ndarray) -> np.ndarray:
        """What Draws.pick() takes; counts are whole, so their sums are exact."""
        ends = self.ends[lang]
        return self.base[lang] + np.minimum(np.searchsorted(ends, u * ends[-1], "right"), len(ends) - 1)


def _fallen(u: np.ndarray, reach: int) -> np.ndarray:
    """Draws.pick() of weights that decay."""
    fall = [0.8**k for k in range(reach)]
    x, out, open_ = u * sum(fall), np.full(len(u), reach - 1), np.ones(len(u), dtype=bool)
    for k, w in enumerate(fall):
        out[open_ & (x < w)] = k
        open_ &= x >= w
        x = x - w
    return out


def _recent(frequent: Frequent, key: str, lang: str | None, n: int, repeat: float, reach: int) -> np.ndarray:
    """Words of a page, of which a share comes again from the last few."""
    if not repeat:
        return frequent.pick(lang, drawn(key, n))
    m = min(n, reach)
    u = drawn(key, 2 * n - m)
    codes = frequent.pick(lang, np.concatenate([u[:m], u[m + 1 :: 2]]))
    again = np.flatnonzero(u[m::2] < repeat)
    source = np.arange(n)
    source[again + m] -= 1 + _fallen(u[m + 1 :: 2][again], reach)
    while (source[source] != source).any():
        source = source[source]
    return codes[source]


def _by_page(docs: DataFrame, frequent: Frequent, f: Callable[[Pages, Lines, int, int, str | None, int], np.ndarray], own: bool = False) -> DataFrame:
    """Lines of words that f gives for each page: (pages, lines, place of the page in lines, id, language, words), as places in frequent.words, with own followed by the batch's."""
    listed = pa.array(frequent.words, pa.string())

    def run(p: Pages) -> Iterator[list]:
        lines = Lines(p)
        codes = [f(p, lines, i, int(p.ids[page]), p.langs[page], b - a) for i, (page, (a, b)) in enumerate(zip(lines.pages.tolist(), lines.words, strict=True))]
        if codes:
            yield _rows(p, lines, _joined(pa.concat_arrays([listed, p.texts]) if own else listed, np.concatenate(codes), lines.upto))

    return over_pages(docs, _SCHEMA, run)


def recency_text(docs: DataFrame, repeat: float = 0.08, reach: int = 8, words: int = 500) -> DataFrame:
    frequent = Frequent(docs, words)
    return _by_page(docs, frequent, lambda p, lines, i, doc, lang, n: _recent(frequent, f"recency:{doc}", lang, n, repeat, reach))


def _key(repeat: float = 0.0, tilt: float = 0.0, own: float = 0.0, drift: str = "") -> str:
    """The key of generating.composed_text(), without the page."""
    return f"composed:{repeat}:0.0:0.0:{tilt}:0.0:{own}:False:{drift}:"


#: Most frequent words of a language that composed texts take, and the language that texts drift to.
WORDS, OTHER = 400, "fr"


def page_mixture_text(docs: DataFrame, own: float = 0.5) -> DataFrame:
    frequent = Frequent(docs, WORDS)

    def page(p: Pages, lines: Lines, i: int, doc: int, lang: str | None, n: int) -> np.ndarray:
        u, (a, b) = drawn(_key(own=own) + str(doc), 2 * n), lines.words[i]
        known = np.array(sorted(np.unique(p.word[a:b]).tolist(), key=p.words.__getitem__))
        mine = known[np.minimum(len(known) - 1, (u[1::2] * len(known)).astype(np.int64))]
        return np.where(u[::2] < own, len(frequent.words) + mine, frequent.pick(lang, u[1::2]))

    return _by_page(docs, frequent, page, own=True)


def _drifting(docs: DataFrame, drift: str) -> DataFrame:
    frequent = Frequent(docs, WORDS)
    letter = WORD.replace("{{", "{").replace("}}", "}").rstrip("+")
    most = docs.where(F.lower("text").rlike(letter)).agg(F.max("doc_id")).first()[0] or 1

    def page(p: Pages, lines: Lines, i: int, doc: int, lang: str | None, n: int) -> np.ndarray:
        key = _key(drift=drift) + str(doc)
        if OTHER not in frequent.base:
            return frequent.pick(lang, drawn(key, n))
        u, far = drawn(key, 2 * n), doc / most if drift == "smooth" else float(doc > most / 2)
        return np.where(u[::2] < far, frequent.pick(OTHER, u[1::2]), frequent.pick(lang, u[1::2]))

    return _by_page(docs, frequent, page)


def smooth_drift_text(docs: DataFrame) -> DataFrame:
    return _drifting(docs, "smooth")


def step_drift_text(docs: DataFrame) -> DataFrame:
    return _drifting(docs, "step")


def tilted_text(docs: DataFrame, tilt: float = 0.5) -> DataFrame:
    frequent = Frequent(docs, WORDS)
    first = [w[0] for w in frequent.words]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def page(p: Pages, lines: Lines, i: int, doc: int, lang: str | None, n: int) -> np.ndarray:
        key, (a, b), out, k, had = _key(tilt=tilt) + str(doc), lines.lines[i], [], 0, 0
        u, codes = [], []
        for no, size in zip(lines.no[a:b].tolist(), lines.n[a:b].tolist(), strict=True):
            favoured = {c for c in letters if Draws("tilt", doc, no, c).uniform() < 0.3}
            while len(u) < k + 3 * size:
                more = drawn(key, 8 * (n // 4 + 8), had)
                had += len(more) // 8
                u += more.tolist()
                codes += frequent.pick(lang, more).tolist()
            if not favoured:
                out += codes[k : k + size]
                k += size
                continue
            for _ in range(size):
                word = codes[k]
                k += 1
                if first[word] not in favoured:
                    if u[k] < tilt:
                        word = codes[k + 1]
                        k += 1
                    k += 1
                out.append(word)
        return np.array(out)

    return _by_page(docs, frequent, page)


def tuning_sweep(docs: DataFrame, shares: tuple[float, ...] = (0.0, 0.1, 0.2, 0.4), reach: int = 8) -> DataFrame:
    """Words of all settings are counted where they are made; tasks return sums."""
    frequent = Frequent(docs, WORDS)

    def sums(p: Pages) -> Iterator[tuple]:
        lines = Lines(p)
        if not len(lines.page):
            return
        pos, lang = np.arange(lines.upto[-1]) - np.repeat(lines.upto[:-1], lines.n), np.repeat(p.lang_of[lines.page], lines.n)
        n = np.bincount(lang, minlength=len(p.names))
        for share in shares:
            codes = np.concatenate([_recent(frequent, _key(repeat=share) + str(p.ids[page]), p.langs[page], b - a, share, reach) for page, (a, b) in zip(lines.pages.tolist(), lines.words, strict=True)])
            hit = np.zeros(len(codes), dtype=bool)
            for k in range(1, 9):
                hit[k:] |= (codes[k:] == codes[:-k]) & (pos[k:] >= k)
            for g, (m, h) in enumerate(zip(n.tolist(), np.bincount(lang, hit, len(p.names)).tolist(), strict=True)):
                if m:
                    yield share, p.names[g], h, m

    rows = over_pages(docs, "share double, lang string, hits double, n bigint", sums, 2)
    return rows.groupBy("share", "lang").agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("repeated"), F.sum("n").alias("n"))


def copied_text(docs: DataFrame, seeds: int = 50) -> DataFrame:
    frequent = Frequent(docs, seeds)
    similar = lambda s, k: s[:k] + SIMILAR.get(s[k], s[k]) + s[k + 1 :]

    def run(p: Pages) -> Iterator[list]:
        lines, texts = Lines(p), []
        for at, (a, b) in zip(lines.pages.tolist(), lines.lines, strict=True):
            page, above, lang, key, had = [], [], p.langs[at], f"copy:{p.ids[at]}", 0
            ends, base, u, i = frequent.ends[lang].tolist(), frequent.base[lang], [], 0
            for n in lines.n[a:b].tolist():
                line: list[str] = []
                while len(u) < i + 5 * n:  # five draws a word at most
                    more = drawn(key, 8 * (n // 2 + 8), had)
                    had += len(more) // 8
                    u = u[i:] + more.tolist()
                    i = 0
                for j in range(n):
                    x = u[i]
                    i += 1
                    if x < 0.6 and above:
                        source = above[min(len(above) - 1, max(0, j + min(2, int(u[i] * 3)) - 1))]
                        i += 1
                    elif x < 0.8 and line:
                        source = line[-1]
                    elif x < 0.95 and page:
                        source = page[min(len(page) - 1, int(u[i] * len(page)))]
                        i += 1
                    else:
                        source = frequent.words[base + min(len(ends) - 1, bisect_right(ends, u[i] * ends[-1]))]
                        i += 1
                    if u[i] >= 0.15:
                        k, y = min(len(source) - 1, int(u[i + 1] * len(source))), u[i + 2]
                        i += 3
                        if y < 0.6:
                            source = similar(source, k)
                        elif y < 0.8 and len(source) > 2:
                            source = source[:k] + source[k + 1 :]
                        else:
                            source = source + "s"
                    else:
                        i += 1
                    line.append(source[:16])
                page += line
                above = line
                texts.append(" ".join(line))
        yield _rows(p, lines, pa.array(texts, pa.string()))

    return over_pages(docs, _SCHEMA, run)


def wrapped_text(docs: DataFrame, width: int = 55, lines: int = 30) -> DataFrame:
    def run(p: Pages) -> Iterator[list]:
        own = Lines(p)
        upto = np.concatenate([[0], np.cumsum(np.array([len(w) for w in p.words] or [0])[p.word] + 1)])
        ends = np.zeros(len(p.word), dtype=np.int64)
        for a, b in own.words:
            ends[a:b] = b
        every = np.arange(len(p.word))
        nexts = np.minimum(np.maximum(np.searchsorted(upto, upto[:-1] + width + 1, "right") - 1, every + 1), ends).tolist()
        starts, k = [], 0
        while k < len(nexts):
            starts.append(k)
            k = nexts[k]
        starts = np.array(starts, dtype=np.int64)
        page = p.page[starts]
        row = np.arange(len(starts)) - np.searchsorted(page, page)
        yield [_langs(p, page), pa.array(p.ids[page]), pa.array(row // lines), pa.array(row % lines), _joined(p.texts, p.word, np.append(starts, len(p.word)))]

    return over_pages(docs, "lang string, doc_id bigint, page bigint, line_no bigint, text string", run)


#: Lines under which letters are drawn one by one, blocks of eight draws that a line takes at a time.
FEW, AHEAD = 48, 8
#: Letters of a word at most.
LONGEST = 20


class Automaton:
    """Letters given the ones before, of all languages, in one table: what may follow a state lies side by side."""

    def __init__(self, docs: DataFrame, order: int):
        grams = types_of(docs).select("lang", "n", F.explode(F.expr(f"transform(sequence(1, length(tok) + 1), i -> substr(concat(repeat('^', {order}), tok, '$'), i, {order + 1}))")).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
        rows = sorted(_small(grams).itertuples(index=False, name=None), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        number: dict[tuple[str | None, str], int] = {}
        state = np.array([number.setdefault((lang, g[:-1]), len(number)) for lang, g, _ in rows], dtype=np.int64)
        n = np.array([n for _, _, n in rows], dtype=np.int64)
        self.ends = np.cumsum(n)
        self.last = np.searchsorted(state, np.arange(len(number)), "right") - 1
        self.total = np.bincount(state, n, len(number))
        self.base = self.ends[self.last] - self.total.astype(np.int64)
        self.sign = np.array([0 if g[-1] == "$" else ord(g[-1]) for _, g, _ in rows], dtype=np.uint32)
        self.next = np.array([number.get((lang, g[1:]), 0) for lang, g, _ in rows], dtype=np.int64)
        self.start = {lang: k for (lang, ctx), k in number.items() if ctx == "^" * order}

    def lines(self, keys: list[str], langs: list[str | None], words: np.ndarray, letters: np.ndarray) -> list[str]:
        """Texts of lines by the keys of their draws. All lines take a letter at a time; the last ones go on by themselves."""
        out: list[list[str]] = [[] for _ in keys]
        open_, block = np.arange(len(keys)), 0
        begin = np.array([self.start[x] for x in langs], dtype=np.int64)
        state, long, size, count = begin.copy(), *(np.zeros(len(keys), dtype=np.int64) for _ in range(3))
        least, most = 0.6 * letters, 1.4 * letters
        while len(open_) >= FEW:
            u = np.ascontiguousarray(np.concatenate([drawn(keys[k], 8 * AHEAD, block) for k in open_.tolist()]).reshape(len(open_), -1).T)
            signs = np.zeros((len(open_), len(u), 2), dtype=np.uint32)
            s, m, z, c, b, w, lo, hi = (x[open_] for x in (state, long, size, count, begin, words, least, most))
            on = np.ones(len(open_), dtype=bool)
            for j, x in enumerate(u):
                e = np.minimum(np.searchsorted(self.ends, self.base[s] + (x * self.total[s]).astype(np.int64), "right"), self.last[s])
                sign = self.sign[e]
                m += sign > 0
                over = (sign == 0) | (m == LONGEST)
                signs[:, j, 0] = np.where(on, sign, 0)
                signs[:, j, 1] = np.where(on & over, 32, 0)
                s = np.where(over, b, self.next[e])
                z += np.where(over, m, 0)
                c += over
                m[over] = 0
                on &= ~over | (z < lo) | ((z < hi) & (c < w))
            met = signs > 0
            text, ends = signs[met].tobytes().decode("utf-32-le"), np.cumsum(met.sum((1, 2))).tolist()
            for k, a, e in zip(open_.tolist(), [0, *ends[:-1]], ends, strict=True):
                out[k].append(text[a:e])
            for x, y in zip((state, long, size, count), (s, m, z, c), strict=True):
                x[open_] = y
            open_, block = open_[on], block + AHEAD
        for k in open_.tolist():
            out[k].append(self._alone(keys[k], block, *(x[k].item() for x in (begin, state, long, size, count, words, least, most))))
        return ["".join(x)[:-1] for x in out]

    def _alone(self, key: str, block: int, begin: int, s: int, m: int, z: int, c: int, words: int, least: float, most: float) -> str:
        if not hasattr(self, "lists"):
            self.lists = [x.tolist() for x in (self.ends, self.base, self.total, self.last, self.next)] + [["" if x == 0 else chr(x) for x in self.sign.tolist()]]
        ends, base, total, last, next_, sign = self.lists
        first = [0, *(x + 1 for x in last)]
        out = []
        while True:
            for u in drawn(key, 512, block).tolist():
                e = bisect_right(ends, base[s] + int(u * total[s]), first[s], last[s])
                if letter := sign[e]:
                    out.append(letter)
                    m += 1
                    if m < LONGEST:
                        s = next_[e]
                        continue
                out.append(" ")
                z, c, m, s = z + m, c + 1, 0, begin
                if z >= least and (z >= most or c >= words):
                    return "".join(out)
            block += 64


def automaton_text(docs: DataFrame, order: int = 2) -> DataFrame:
    automaton = Automaton(docs, order)

    def run(p: Pages) -> Iterator[list]:
        lines = Lines(p)
        keys = [f"automaton:{a}:{b}" for a, b in zip(p.ids[lines.page].tolist(), lines.no.tolist(), strict=True)]
        yield _rows(p, lines, pa.array(automaton.lines(keys, [p.langs[k] for k in lines.page.tolist()], lines.n, lines.letters), pa.string()))

    return over_pages(docs, _SCHEMA, run)


def _bits(text: str) -> float:
    return 8 * len(lzma.compress(text.encode(), format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 1}])) / max(len(text), 1)


def twin_residual(docs: DataFrame, least_lines: int = 30) -> DataFrame:
    """Only pages of least_lines lines and more have twins made; tasks return sums."""
    automaton = Automaton(docs, 2)

    def sums(p: Pages) -> Iterator[tuple]:
        lines = Lines(p)
        parts = [(page, a, b) for page, (a, b) in zip(lines.pages.tolist(), lines.lines, strict=True) if b - a >= least_lines]
        if not parts:
            return
        held = np.concatenate([np.arange(a, b) for _, a, b in parts])
        keys = [f"automaton:{a}:{b}" for a, b in zip(p.ids[lines.page[held]].tolist(), lines.no[held].tolist(), strict=True)]
        twins, k = automaton.lines(keys, [p.langs[x] for x in lines.page[held].tolist()], lines.n[held], lines.letters[held]), 0
        for page, a, b in parts:
            words, upto = [p.words[w] for w in p.word[lines.upto[a] : lines.upto[b]].tolist()], (lines.upto[a : b + 1] - lines.upto[a]).tolist()
            real = "\n".join(" ".join(words[x:y]) for x, y in zip(upto[:-1], upto[1:], strict=True))
            yield p.langs[page], 1, _bits(real) - _bits("\n".join(twins[k : k + b - a]))
            k += b - a

    rows = over_pages(docs, "lang string, pages bigint, s double", sums, 2)
    return rows.groupBy("lang").agg(F.sum("pages").alias("pages"), F.round(F.sum("s") / F.sum("pages"), 6).alias("residual"))


#: Words of a page's packings that are worked on at a time.
PART = 1 << 19


def _ninetieth(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Percentile 90 of the first n numbers of each row, which are sorted, as np.percentile() takes it."""
    at = (n - 1) * 0.9
    low = np.floor(at).astype(np.int64)
    a, b, t = *(np.take_along_axis(x, np.minimum(k, n - 1)[:, None], 1)[:, 0].astype(float) for k in (low, low + 1)), at - low
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def _packed(sizes: np.ndarray, width: float, rng: np.random.Generator, sims: int) -> np.ndarray:
    """Mean slack of each packing of shuffled words of these sizes that has two whole lines: all packings take a line at a time."""
    n, means = len(sizes), []
    room = int(np.floor(width + 1 + 1e-9))
    step = int((sizes + 1).sum()) + room + 1
    for done in range(0, sims, part := max(1, PART // n)):
        rows = min(part, sims - done)
        upto = np.zeros((rows, n + 1), dtype=np.int64)
        for k in range(rows):
            upto[k, 1:] = rng.permutation(sizes)
        upto[:, 1:] += 1
        np.cumsum(upto, axis=1, out=upto)
        upto += np.arange(rows)[:, None] * step
        flat = upto.ravel()
        found, m, r = [], np.zeros(rows, dtype=np.int64), np.arange(rows)
        at, ends = r * (n + 1), (r + 1) * (n + 1) - 1
        while len(r):
            begin = flat[at]
            to = np.maximum(np.searchsorted(flat, begin + room, "right") - 1, at + 1)
            on = to < ends
            r, at, begin, ends = r[on], to[on], begin[on], ends[on]
            line = np.full(rows, np.iinfo(np.int64).max)
            line[r] = flat[at] - begin - 1
            found.append(line)
            m[r] += 1
        held = m >= 2
        if held.any():
            x, m = np.sort(np.stack(found, axis=1)[held], axis=1), m[held]
            slack = np.maximum(0, _ninetieth(x, m)[:, None] - x)
            slack[np.arange(x.shape[1]) >= m[:, None]] = 0
            means.append(slack.sum(1) / m)
    return np.concatenate(means) if means else np.zeros(0)


def line_packing(docs: DataFrame, sims: int = 200, least: int = 8) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        lines, size = Lines(p), np.array([len(w) for w in p.words] or [0])
        for page, (a, b), (c, d) in zip(lines.pages.tolist(), lines.lines, lines.words, strict=True):
            if b - a < least:
                continue
            width = lines.letters[a:b] + lines.n[a:b] - 1
            w = float(np.percentile(width, 90))
            means = _packed(size[p.word[c:d]], w, seeded("pack", p.ids[page]), sims)
            if len(means):
                yield p.langs[page], 1, float(np.maximum(0, w - width).sum()), float(means.mean()) * len(width)

    rows = over_pages(docs, "lang string, pages bigint, slack double, chance double", sums, 3)
    return rows.groupBy("lang").agg(F.sum("pages").alias("pages"), F.round(F.sum("slack") / F.sum("chance"), 6).alias("ratio"))


#: Kernels that have such a form.
PAGED: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (
    automaton_text, copied_text, recency_text, wrapped_text, page_mixture_text, smooth_drift_text, step_drift_text, tilted_text, tuning_sweep, twin_residual,
    line_packing,
)}
