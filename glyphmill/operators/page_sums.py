"""More plans on arrays of whole pages (pages.py): tasks return sums by page groups or counts of letters and types, and SQL ends them."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.dialect import SPARK, poisson
from glyphmill.functions.lineage import settled
from glyphmill.operators import pairs
from glyphmill.operators.distances import Edits
from glyphmill.operators.hashing import digests
from glyphmill.operators.pages import Pages, over_pages
from glyphmill.plans import edits, recency, replication
from glyphmill.sources.corpus import PAGE_WORDS, query


def _u(keys: list[bytes]) -> np.ndarray:
    """Dialect's u() of many keys."""
    return (digests(np.array(keys, dtype="S")) >> np.uint64(32))[:, 0] / 4294967296.0


def _alike(edits: Edits, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 less edits over the longer one's letters; pairs that come more than once are compared once."""
    kinds = max(len(edits.size), 1)
    pair, at = np.unique(np.minimum(x, y) * kinds + np.maximum(x, y), return_inverse=True)
    a, b = pair // kinds, pair % kinds
    return (1 - edits.of(a, b) / np.maximum(np.maximum(edits.size[a], edits.size[b]), 1))[at]


def _places(p: Pages) -> np.ndarray:
    """Classes of places as recency._words() has them, -1 without one."""
    n = np.append(p.count, 0)
    first, last = n[p.at - 1] == 0, n[p.at + 1] == 0
    cls = (np.minimum(p.pos, 2) - 1) * 4 + (np.minimum(p.n_line - 1 - p.pos, 2) - 1) * 2 + last
    return np.where(~first & (p.pos > 0) & (p.pos < p.n_line - 1), cls, -1)


#: Distances of words that are compared, and pairs that are picked for an expectation.
NEAR, PICKS = range(2, 8), 25


def e1_graded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Neighbouring lines with words are of one paragraph, as an empty line ends one."""

    def sums(p: Pages) -> Iterator[tuple]:
        words, cls = Edits(p.words), _places(p)
        own = np.flatnonzero(cls >= 0)
        big = np.bincount(p.page[own], minlength=len(p.ids)) >= 10
        cells, values, sizes = [], [], []
        for dist in NEAR:
            x = np.arange(max(len(cls) - dist, 0))
            y, apart = x + dist, p.at[dist:] - p.at[: len(x)]
            x = x[(cls[x] >= 0) & (cls[y] >= 0) & (p.page[x] == p.page[y]) & (apart <= 1) & big[p.page[x]]]
            y = x + dist
            cell, at = np.unique((((p.page[x] * 8 + dist) * 2 + (p.at[y] > p.at[x])) * 8 + cls[x]) * 8 + cls[y], return_inverse=True)
            cells.append(cell)
            sizes.append(np.bincount(at, minlength=len(cell)))
            values.append(np.bincount(at, _alike(words, p.word[x], p.word[y]), len(cell)))
        cell, n, s = np.concatenate(cells), np.concatenate(sizes), np.concatenate(values)
        # means of picked pairs, for the classes that are met
        page, both = cell // 1024, cell % 64
        group, of = np.unique(page * 64 + both, return_inverse=True)
        order = own[np.argsort(p.page[own] * 8 + cls[own], kind="stable")]
        held = np.bincount(p.page[own] * 8 + cls[own], minlength=len(p.ids) * 8)
        start = np.cumsum(held) - held
        picked = []
        for side, c in ((b"ex", group % 64 // 8), (b"ey", group % 8)):
            keys = [b"%s%d:%d%d:%d" % (side, i, a, b, k) for i, a, b in zip(p.ids[group // 64].tolist(), (group % 64 // 8).tolist(), (group % 8).tolist(), strict=True) for k in range(1, PICKS + 1)]
            at = np.repeat(group // 64 * 8 + c, PICKS)
            picked.append(p.word[order[start[at] + np.floor(_u(keys) * held[at]).astype(np.int64)]])
        chance = _alike(words, *picked).reshape(-1, PICKS).mean(1)
        e, dist, next_ = n * chance[of], cell // 128 % 8, cell // 64 % 2
        groups = (digests(np.array([b"eg%d" % i for i in p.ids.tolist()], dtype="S"))[:, 0] >> np.uint64(32)).astype(np.int64) % recency.GROUPS
        key, at = np.unique((p.lang_of[page] * recency.GROUPS + groups[page]) * 8 + dist, return_inverse=True)
        columns = [np.bincount(at, np.where(next_ == kind, v, 0.0), len(key)) for kind in (0, 1) for v in (s, e)]
        for k, *row in zip(key.tolist(), *(c.tolist() for c in columns), strict=True):
            if (lang := p.names[k // 8 // recency.GROUPS]) is not None:
                yield lang, k // 8 % recency.GROUPS, k % 8, *row

    names = [f"{v}_{kind}" for kind in ("same", "next") for v in "se"]
    rows = over_pages(docs, f"lang string, grp bigint, dist bigint, {', '.join(f'{c} double' for c in names)}", sums, 4)
    u = SPARK.u("concat('eg', lang, cast(grp as string), ':', cast(rep as string))")
    total, drawn = ", ".join(f"sum({c}) as {c}" for c in names), ", ".join(f"sum(wt * {c}) as {c}" for c in names)
    weighed = f"select *, case when rep = 0 then 1 else {poisson('u')} end as wt from (select lang, grp, rep, dist, {', '.join(names)}, {u} as u from (select lang, grp, dist, {total} from {{rows}} group by lang, grp, dist) g {SPARK.each('0', str(recency.DRAWS), 'rep')}) v"
    mean = lambda low, high: f"avg(case when dist between {low} and {high} and e_same > 0 then s_same / e_same end)"
    step = "sum(least(e_same, e_next) * (s_next / greatest(e_next, 1e-12) - s_same / greatest(e_same, 1e-12))) / nullif(sum(least(e_same, e_next)), 0.0e0)"
    steps = f"select lang, rep, {mean(2, 3)} - {mean(5, 7)} as wld, {step} as ls from (select lang, rep, dist, {drawn} from ({weighed}) w group by lang, rep, dist) p group by lang, rep"
    ends = ", ".join(f"'{k}', max(case when rep = 0 then {k} end), percentile(case when rep > 0 then {k} end, 0.025), percentile(case when rep > 0 then {k} end, 0.975)" for k in ("wld", "ls"))
    return query(spark, f"select lang, stat, round(value, 6) as value, round(low, 6) as low, round(high, 6) as high from (select lang, stack(2, {ends}) as (stat, value, low, high) from ({steps}) s group by lang) t", {"rows": rows})


def _ln_factorials(most: int) -> np.ndarray:
    """Dialect's ln_factorial() of 0 to most."""
    x = np.arange(max(most, 15) + 1, dtype=float)
    x[:16] = np.maximum(x[:16], 1)
    out = (x + 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    out[:16] = np.log([float(np.prod(np.arange(1.0, k + 1))) for k in range(16)])
    return out


def _dealt(n: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """What cells of margins fa and fb of n rows add to information.dealt(), each; values that come more than once are worked out once."""
    most = int(n.max(initial=0)) + 1
    key, at = np.unique((n * most + np.minimum(fa, fb)) * most + np.maximum(fa, fb), return_inverse=True)
    n, fa, fb = key // most // most, key // most % most, key % most
    ln, mean = _ln_factorials(most), fa * 1.0 * fb / n
    spread = 10 * np.sqrt(mean) + 10
    low = np.maximum.reduce([np.ones(len(n), dtype=np.int64), fa + fb - n, np.floor(mean - spread).astype(np.int64)])
    high = np.minimum.reduce([fa, fb, np.ceil(mean + spread).astype(np.int64)])
    room = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), room)
    met = np.arange(len(row)) - np.repeat(np.cumsum(room) - room - low, room)
    n, fa, fb = n[row], fa[row], fb[row]
    chance = np.exp(ln[fa] + ln[fb] + ln[n - fa] + ln[n - fb] - ln[n] - ln[met] - ln[fa - met] - ln[fb - met] - ln[n - fa - fb + met])
    return np.bincount(row, met / n * np.log2(met * 1.0 * n / (fa * 1.0 * fb)) * chance, len(key))[at]


def _excess_of(group: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Information of pairs (a, b) of each group of size pairs, less what dealing b anew gives."""
    groups, h, margins = len(size), np.zeros(len(size)), []
    for sign, of in ((1, group * (int(a.max(initial=0)) + 1) + a), (-1, group * (int(a.max(initial=0)) + 1) + a), (-1, group * (int(b.max(initial=0)) + 1) + b)):
        if sign > 0:
            of = of * (int(b.max(initial=0)) + 1) + b
        _, first, c = np.unique(of, return_index=True, return_counts=True)
        h += sign * np.bincount(group[first], c * np.log2(c), groups)
        if sign < 0:
            most = int(size.max(initial=0)) + 1
            cell, m = np.unique(group[first] * most + c, return_counts=True)
            margins.append((cell // most, cell % most, m))
    mi = np.maximum(np.log2(size) + h / size, 0.0)
    (ga, fa, ma), (gb, fb, mb) = margins
    n = np.bincount(gb, minlength=groups)
    start, row = np.cumsum(n) - n, np.repeat(np.arange(len(ga)), n[ga])
    other = start[ga[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n[ga]) - n[ga], n[ga])
    return mi - np.bincount(ga[row], ma[row] * mb[other] * _dealt(size[ga[row]], fa[row], fb[other]), groups)


def t1_line_break(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        (last, _), (first, _) = p.numbers(lambda w: w[-1:]), p.numbers(lambda w: w[:1])
        page_of = np.zeros(p.room, dtype=np.int64)
        page_of[p.at] = p.page
        long = np.flatnonzero(p.count >= 2)
        i = np.flatnonzero(page_of[long[:-1]] == page_of[long[1:]])
        page, a, b = page_of[long[i]], last[p.first[long[i]] + p.count[long[i]] - 1], first[p.first[long[i + 1]]]
        known = np.array([x is not None for x in p.names], dtype=bool)[p.lang_of] if p.names else np.zeros(0, dtype=bool)
        k = np.bincount(page, minlength=len(p.ids))
        k[(k < 2) | ~known] = 0
        on = k[page] > 0
        page, a, b = page[on], a[on], b[on]
        x = np.flatnonzero(p.pos + 1 < p.n_line)
        x = x[k[p.page[x]] > 0]
        n = np.bincount(p.page[x], minlength=len(p.ids))
        nth = np.arange(len(x)) - (np.cumsum(n) - n)[p.page[x]]
        full = n // np.maximum(k, 1)
        held = nth < (full * k)[p.page[x]]
        x, nth = x[held], nth[held]
        # a page's breaks are block 0, its full blocks follow
        blocks = np.where(k > 0, full + 1, 0)
        base = np.cumsum(blocks) - blocks
        of = np.repeat(np.arange(len(p.ids)), blocks)
        excess = _excess_of(np.concatenate([base[page], base[p.page[x]] + 1 + nth // k[p.page[x]]]), k[of], np.concatenate([a, last[x]]), np.concatenate([b, first[x + 1]]))
        held = np.flatnonzero(full * (k > 0))
        inner = (np.bincount(of, excess, len(p.ids))[held] - excess[base[held]]) / full[held]
        for g in np.unique(p.lang_of[held]).tolist():
            one = p.lang_of[held] == g
            own = held[one]
            yield p.names[g], len(own), int(k[own].sum()), float((excess[base[own]] * k[own]).sum()), float((inner[one] * k[own]).sum())

    rows = over_pages(docs, "lang string, pages bigint, k bigint, b double, i double", sums, 4)
    return query(spark, "select lang, round(sum(b) / sum(k), 6) as break_, round(sum(i) / sum(k), 6) as inner_, sum(pages) as pages from {rows} group by lang", {"rows": rows})


def page_cosine(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pages as packed word counts, all pairs of a source in blocks; nothing is made for a word of a pair."""

    def each(p: Pages) -> Iterator[list]:
        kinds = max(len(p.words), 1)
        cell, n = np.unique(p.page * kinds + p.word, return_counts=True)
        held, first = np.unique(cell // kinds, return_index=True)
        parts = [slice(x, y) for x, y in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=True)]
        words = [p.words[w] for w in (cell % kinds).tolist()]
        packed = [zlib.compress("\n".join(words[x]).encode(), 1) for x in parts]
        yield [pa.array(p.ids[held]), pa.array([p.langs[k] for k in held.tolist()], pa.string()), p.sources.take(pa.array(held)), pa.array(packed, pa.binary()), pa.array([n[x].astype(np.int32).tobytes() for x in parts], pa.binary())]

    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("cos", pa.float64())])

    def near(source: str, a: pairs.Counted, b: pairs.Counted, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, value in pairs.cosines(a, b, same, 0.499999):
            x, y = a.ids[i], b.ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(value)], schema=schema)

    profiles = over_pages(docs, "doc_id bigint, lang string, source string, symbols binary, counts binary", each)
    found = pairs.in_blocks(profiles, near, "i bigint, j bigint, cos double", pairs.Counted, docs)
    return query(spark, "select i, j, round(cos, 6) as cosine from {rows} where round(cos, 6) >= 0.5e0", {"rows": found})


def space_gain(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Slots as counts of two letters: n, and k of them where a word ends."""
    room = 1 << 21

    def sums(p: Pages) -> Iterator[tuple]:
        size = np.array([len(w) for w in p.words] or [0], dtype=np.int64)
        letters = np.frombuffer("".join(p.words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        first, kinds = np.cumsum(size) - size, max(len(p.words), 1)
        half = np.fmod(p.ids.astype(np.int64), 2) if len(p.ids) else p.lang_of
        x = np.flatnonzero((p.pos + 1 < p.n_line) & (half[p.page] >= 0))
        group = p.lang_of[p.page[x]] * 2 + half[p.page[x]]
        ends, k = np.unique((group * room + letters[first[p.word[x]] + size[p.word[x]] - 1]) * room + letters[first[p.word[x + 1]]], return_counts=True)
        met, times = np.unique(group * kinds + p.word[x], return_counts=True)
        m = size[met % kinds] - 1
        row = np.repeat(np.arange(len(met)), m)
        at = first[met[row] % kinds] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        inner, of = np.unique((met[row] // kinds * room + letters[at]) * room + letters[at + 1], return_inverse=True)
        n = np.bincount(of, times[row], len(inner))
        for key, more, ended in ((ends, k, True), (inner, n, False)):
            for c, v in zip(key.tolist(), more.tolist(), strict=True):
                if (lang := p.names[c // room // room // 2]) is not None:
                    yield lang, c // room // room % 2, chr(c // room % room), chr(c % room), int(v), int(v) if ended else 0

    rows = over_pages(docs, "lang string, half bigint, l string, r string, n bigint, k bigint", sums, 2)
    of = lambda c: ", ".join(f"sum(case when half = {h} then {c} else 0 end) as {c}{h}" for h in (0, 1))
    cells = f"select lang, l, r, {of('n')}, {of('k')} from {{rows}} group by lang, l, r"
    bits = lambda p: f"k1 * log2({p}) + (n1 - k1) * log2(1 - {p})"
    told = "select c.lang, n1, k1, p0, (k0 * 1.0e0 + p0) / (n0 + 1) as p from cells c join (select lang, sum(k0) * 1.0e0 / sum(n0) as p0 from cells group by lang having sum(n0) > 0) b on b.lang = c.lang where n1 > 0"
    mean = lambda v: f"sum({v}) / sum(case when {v} is not null then n1 end)"
    sure = lambda c: f"sum(case when p >= 0.5e0 then {c} else 0 end) * 1.0e0"
    return query(spark, f"with cells as ({cells}) select lang, cast(sum(n1) as bigint) as slots, round(1 + {mean(bits('p'))} / -({mean(bits('p0'))}), 6) as gain, round({sure('k1')} / nullif({sure('n1')}, 0.0e0), 6) as precision_, round({sure('k1')} / sum(k1), 6) as recall_ from ({told}) t group by lang", {"rows": rows})


def t2a_difference(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        (last, letters), (size, sizes) = p.numbers(lambda w: w[-1:]), p.numbers(lambda w: str(min(len(w), 8)))
        groups = (digests(np.array([b"rt%d" % i for i in p.ids.tolist()], dtype="S"))[:, 0] >> np.uint64(32)).astype(np.int64) % replication.GROUPS
        n = np.append(p.count, 0)
        x = np.flatnonzero((p.n_line >= 2) & (p.pos > 0))
        kind = np.where(p.pos[x] < p.n_line[x] - 1, 0, np.where(n[p.at[x] + 1] > 0, 1, 2))
        cell, c = np.unique((((p.lang_of[p.page[x]] * replication.GROUPS + groups[p.page[x]]) * len(sizes) + size[x]) * len(letters) + last[x]) * 3 + kind, return_counts=True)
        for k, m in zip(cell.tolist(), c.tolist(), strict=True):
            rest = k // 3 // len(letters) // len(sizes)
            if (lang := p.names[rest // replication.GROUPS]) is not None:
                yield lang, rest % replication.GROUPS, int(sizes[k // 3 // len(letters) % len(sizes)]), letters[k // 3 % len(letters)], ("inner", "margin", "para")[k % 3], m

    rows = over_pages(docs, "lang string, grp bigint, len bigint, sym string, kind string, c bigint", sums, 1)
    return query(spark, "with c as (select lang, grp, len, sym, kind, sum(c) * 1.0e0 as c from {rows} group by lang, grp, len, sym, kind)," + replication.t2a_ends(SPARK, "select distinct lang from {docs}"), {"rows": rows, "docs": docs})


def _offset(spark: SparkSession, pages: DataFrame, sums: str) -> DataFrame:
    """pages (lang, doc_id, n, ...) with start, the words before a page in its language, and sums ('x as y') of the pages before: counted by blocks of ids, so no language is one task."""
    parts = [("n", "start"), *(x.split(" as ") for x in sums.split(", ") if x)]
    blocks = "select lang, block, " + ", ".join(f"sum(sum({x})) over (partition by lang order by block) - sum({x}) as {y}" for x, y in parts) + " from p group by lang, block"
    own = ", ".join(f"b.{y} + sum({x}) over (partition by p.lang, p.block order by doc_id) - {x} as {y}" for x, y in parts)
    return query(spark, f"with p as (select *, cast(floor(doc_id / 4096.0e0) as bigint) as block from {{pages}} where lang is not null), b as ({blocks}) select p.*, {own} from p join b on b.lang = p.lang and b.block = p.block", {"pages": pages})


#: Words of a bucket of places.
PLACES = 1 << 16


def window_percentiles(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pages hold the places of their words of one letter; ends of windows meet the page that they lie in by buckets of places."""

    def each(p: Pages) -> Iterator[list]:
        n = np.bincount(p.page, minlength=len(p.ids))
        held = np.flatnonzero(n)
        one = np.flatnonzero(np.array([len(w) == 1 for w in p.words] or [False])[p.word])
        ones = np.bincount(p.page[one], minlength=len(p.ids))
        at = (one - (np.cumsum(n) - n)[p.page[one]]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ones[held])).astype(np.int32)), pa.array(at))
        yield [pa.array(p.ids[held]), pa.array([p.langs[k] for k in held.tolist()], pa.string()), p.sources.take(pa.array(held)), pa.array(n[held]), pa.array(ones[held]), places]

    pages = settled(over_pages(docs, "doc_id bigint, lang string, source string, n bigint, ones bigint, places array<int>", each))
    placed = _offset(spark, pages, "ones as before")
    own = "select lang, source, sum(ones) * 1.0e0 / sum(n) as v, sum(n) as size from {pages} group by lang, source"
    starts = f"select lang, source, v, size, k, cast(floor({SPARK.u("concat('w', lang, coalesce(source, ''), cast(k as string))")} * (n - size)) as bigint) as s from (select o.lang, o.source, v, size, n from ({own}) o join (select lang, sum(n) as n from {{pages}} group by lang) m on o.lang = m.lang) z {SPARK.each('1', '50', 'k')}"
    ends = f"select lang, source, v, size, k, side, case when side = 1 then s + size else s end as r from ({starts}) a {SPARK.each('0', '1', 'side')} where s is not null"
    over = f"select * from (select *, cast(floor(start / {PLACES}.0e0) as bigint) as low, cast(floor((start + n) / {PLACES}.0e0) as bigint) as high from {{placed}}) p {SPARK.each('low', 'high', 'bucket')}"
    told = f"select t.lang, t.source, v, size, k, max(case when side = 1 then before + size(filter(places, x -> x < r - start)) end) as b, max(case when side = 0 then before + size(filter(places, x -> x < r - start)) end) as a from (select *, cast(floor(r / {PLACES}.0e0) as bigint) as bucket from ({ends}) e) t join ({over}) o on o.lang = t.lang and o.bucket = t.bucket and t.r > o.start and t.r <= o.start + o.n group by t.lang, t.source, v, size, k"
    return query(spark, f"select lang, source, round(max(v), 6) as share, round(avg(case when (b - coalesce(a, 0)) * 1.0e0 / size < v - 1e-12 then 1.0e0 else 0.0e0 end), 6) as percentile_ from ({told}) w group by lang, source", {"pages": pages, "placed": placed})


def poured_text(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Words travel as their last letters, layouts as their lines' ends; both are cut at buckets of places, where they meet."""

    def each(p: Pages) -> Iterator[list]:
        n, last = np.bincount(p.page, minlength=len(p.ids)), [w[-1:] for w in p.words]
        held = np.flatnonzero(n)
        first = np.cumsum(n) - n
        letters = [last[w] for w in p.word.tolist()]
        ends = np.flatnonzero(p.pos == p.n_line - 1)
        m = np.bincount(p.page[ends], minlength=len(p.ids))
        places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(m[held])).astype(np.int32)), pa.array((ends - first[p.page[ends]]).astype(np.int32)))
        yield [pa.array(p.ids[held]), pa.array([p.langs[k] for k in held.tolist()], pa.string()), pa.array(n[held]), pa.array(["".join(letters[a : a + b]) for a, b in zip(first[held].tolist(), n[held].tolist(), strict=True)], pa.string()), places]

    pages = settled(over_pages(docs, "doc_id bigint, lang string, n bigint, letters string, ends array<int>", each))
    placed = _offset(spark, pages, "")
    turn = "select lang, coalesce(lead(lang) over (order by lang), min(lang) over ()) as layout, total from (select lang, sum(n) as total from {pages} where lang is not null group by lang) s"
    # r: places of a page's first word in the words that are poured, which begin anew at total
    words = f"select t.lang, t.layout, t.total, 0 as kind, start, n, letters, cast(null as array<int>) as ends from {{placed}} p join ({turn}) t on t.lang = p.lang"
    lines = f"select t.lang, t.layout, t.total, 1 as kind, start, n, cast(null as string), ends from {{placed}} p join ({turn}) t on t.layout = p.lang"
    joined = query(spark, f"select lang, layout, total, kind, cast(start % total as bigint) as start, n, letters, ends from ({words} union all {lines}) u", {"pages": pages, "placed": placed})
    schema = pa.schema([("lang", pa.string()), ("layout", pa.string()), ("bucket", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("letters", pa.string()), ("ends", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, layout, total, start, n, letters, ends in zip(*(batch.column(c).to_pylist() for c in ("lang", "layout", "total", "start", "n", "letters", "ends")), strict=True):
                done, ends = 0, None if ends is None else np.array(ends, dtype=np.int32)
                while done < n:
                    r = (start + done) % total
                    size = min(n - done, total - r, PLACES - r % PLACES)
                    own = None if ends is None else (ends[slice(*np.searchsorted(ends, [done, done + size]))] - done)
                    out.append((lang, layout, r // PLACES, r % PLACES, size, None if letters is None else letters[done : done + size], own))
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, schema.types, strict=True)], schema=schema)

    counts = pa.schema([("lang", pa.string()), ("layout", pa.string()), ("sym", pa.string()), ("n", pa.int64()), ("at_end", pa.float64())])

    def met(group: pa.Table) -> pa.Table:
        letters = np.zeros(PLACES, dtype=np.uint32)
        steps, ended = np.zeros(PLACES + 1, dtype=np.int64), np.zeros(PLACES, dtype=np.int64)
        for at, n, own, ends in zip(*(group.column(c).to_pylist() for c in ("at", "n", "letters", "ends")), strict=True):
            if own is not None:
                letters[at : at + n] = np.frombuffer(own.encode("utf-32-le"), dtype="<u4")
            else:
                steps[at] += 1
                steps[at + n] -= 1
                ended[at + np.array(ends, dtype=np.int64)] += 1
        syms, of = np.unique(letters, return_inverse=True)
        n, m = np.bincount(of, np.cumsum(steps)[:-1], len(syms)).astype(np.int64), np.bincount(of, ended, len(syms))
        held = np.flatnonzero(n)
        zero = pa.array(np.zeros(len(held), dtype=np.int64))
        return pa.Table.from_arrays([*(group.column(c).combine_chunks().slice(0, 1).take(zero) for c in ("lang", "layout")), pa.array([chr(k) for k in syms[held].tolist()], pa.string()), pa.array(n[held]), pa.array(m[held])], schema=counts)

    pieces = joined.mapInArrow(cut, "lang string, layout string, bucket bigint, at bigint, n bigint, letters string, ends array<int>")
    rows = pieces.groupBy("lang", "bucket").applyInArrow(met, "lang string, layout string, sym string, n bigint, at_end double")
    return query(spark, "select lang, layout, sym, sum(n) as n, sum(at_end) as at_end from {rows} group by lang, layout, sym", {"rows": rows})


#: Buckets of a language's words, by a hash.
BUCKETS = 256


def _pairs(docs: DataFrame, schema: str, f: Callable[[str, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.Table]], edits: bool) -> DataFrame:
    """f of each bucket of a language's words: (language, words; first and second words of neighbours, counts, distances up to 3; second words with counts by distance).

    Neighbours are in the bucket of their first word, and second words in their own, so both words' counts are whole there.
    """

    def each(p: Pages) -> Iterator[list]:
        kinds = max(len(p.words), 1)
        own = np.array([zlib.crc32(w.encode()) % BUCKETS for w in p.words] or [0], dtype=np.int64)
        x = np.flatnonzero(p.pos + 1 < p.n_line)
        key, c = np.unique((p.lang_of[p.page[x]] * kinds + p.word[x]) * kinds + p.word[x + 1], return_counts=True)
        lang, a, b = key // kinds // kinds, key // kinds % kinds, key % kinds
        ed = np.minimum(Edits(p.words).of(a, b), 3) if edits else np.zeros(len(a), dtype=np.int64)
        seconds, at = np.unique(lang * kinds + b, return_inverse=True)
        by = np.stack([np.bincount(at, np.where(ed == k, c, 0), len(seconds)) for k in range(4)], axis=1).astype(np.int64)
        left, right = lang * BUCKETS + own[a], seconds // kinds * BUCKETS + own[seconds % kinds]
        order, other = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        met = np.unique(np.concatenate([left, right]))
        cuts = [zip(np.searchsorted(v[o], met).tolist(), np.searchsorted(v[o], met, "right").tolist(), strict=True) for v, o in ((left, order), (right, other))]
        packed = []
        for (i, j), (k, m) in zip(*cuts, strict=True):
            x, y = order[i:j], other[k:m]
            words, code = np.unique(np.concatenate([a[x], b[x], seconds[y] % kinds]), return_inverse=True)
            packed.append(zlib.compress(pickle.dumps(("\n".join(p.words[w] for w in words.tolist()), code.astype(np.int32).tobytes(), c[x].astype(np.int32).tobytes(), ed[x].astype(np.int8).tobytes(), by[y].astype(np.int32).tobytes())), 1))
        yield [pa.array(p.names, pa.string()).take(pa.array(met // BUCKETS)), pa.array(met % BUCKETS), pa.array(packed, pa.binary())]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            for packed in batch.column("packed"):
                text, code, c, ed, by = pickle.loads(zlib.decompress(packed.as_py()))
                c, ed, by = (np.frombuffer(v, dtype=t).astype(np.int64) for v, t in ((c, np.int32), (ed, np.int8), (by, np.int32)))
                code = np.array([known.setdefault(w, len(known)) for w in text.split("\n")], dtype=np.int64)[np.frombuffer(code, dtype=np.int32)]
                for part, v in zip(parts, (code[: len(c)], code[len(c) : 2 * len(c)], c, ed, code[2 * len(c) :], by.reshape(-1, 4)), strict=True):
                    part.append(v)
        a, b, c, ed, tok, by = (np.concatenate(v) for v in parts)
        cell, first, at = np.unique(a * len(known) + b, return_index=True, return_inverse=True)
        counts = np.stack([np.bincount(tok, by[:, k], len(known)) for k in range(4)], axis=1)
        yield from f(key[0].as_py(), list(known), cell // len(known), cell % len(known), np.bincount(at, c, len(cell)), ed[first], np.flatnonzero(counts.any(1)), counts)

    rows = over_pages(docs.where("lang is not null"), "lang string, bucket bigint, packed binary", each)
    return rows.groupBy("lang", "bucket").applyInArrow(run, schema)


def pmi_by_edit_distance(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """c log2 c / (ca cb), summed by distance, falls apart in sums over pairs, first words and second words."""
    schema = pa.schema([("lang", pa.string()), ("ed", pa.int64()), ("c", pa.float64()), ("h", pa.float64())])

    def sums(lang: str, words: list[str], a: np.ndarray, b: np.ndarray, c: np.ndarray, ed: np.ndarray, tok: np.ndarray, by: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.bincount(a, c, len(words))
        h = np.bincount(ed, c * (np.log2(c) - np.log2(first[a])), 4) - (by[tok] * np.log2(by[tok].sum(1))[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * 4), pa.array(range(4), pa.int64()), pa.array(np.bincount(ed, c, 4)), pa.array(h)], schema=schema)

    rows = _pairs(docs, "lang string, ed bigint, c double, h double", sums, True)
    sums_ = "select lang, ed, sum(c) as c, sum(h) as h, sum(sum(c)) over (partition by lang) as n from {rows} group by lang, ed"
    return query(spark, f"select lang, ed, cast(c as bigint) as pairs, round((h + c * log2(n)) / n, 6) as part from ({sums_}) s where c > 0", {"rows": rows})


#: Least count of a collocation, and how many of a language.
LEAST, MOST = 5, 20


def collocations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of pairs met LEAST times have a; those of second words met as often do not; ca is null in one that has the bucket's pairs as c."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("c", pa.float64()), ("ca", pa.float64())])

    def often(lang: str, words: list[str], a: np.ndarray, b: np.ndarray, c: np.ndarray, ed: np.ndarray, tok: np.ndarray, by: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, first, second = pa.array(words, pa.string()), np.bincount(a, c, len(words)), by.sum(1)
        x, y = np.flatnonzero(c >= LEAST), tok[second[tok] >= LEAST]
        none = pa.nulls(len(y) + 1, pa.string())
        columns = [pa.array([lang]).take(pa.array(np.zeros(len(x) + len(y) + 1, dtype=np.int64))), pa.concat_arrays([texts.take(pa.array(a[x])), none]), pa.concat_arrays([texts.take(pa.array(b[x])), texts.take(pa.array(y)), pa.nulls(1, pa.string())])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([c[x], second[y], [c.sum()]])), pa.array(np.concatenate([first[a[x]], np.zeros(len(y) + 1)]))], schema=schema)

    rows = settled(_pairs(docs, "lang string, a string, b string, c double, ca double", often, False))
    scored = "select p.lang, p.a, p.b, p.c, round(p.c * log2(p.c * n / (p.ca * s.c)), 6) as score from {rows} p join (select lang, b, c from {rows} where a is null and b is not null) s on s.lang = p.lang and s.b = p.b join (select lang, sum(c) as n from {rows} where b is null group by lang) z on z.lang = p.lang where p.a is not null"
    return query(spark, f"select lang, a, b, cast(c as bigint) as n, score from (select *, row_number() over (partition by lang order by score desc, a, b) as r from ({scored}) y) x where r <= {MOST}", {"rows": rows})


def _met_by_chance(n: float, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Of n rows, what a cell of each two margins adds to information.dealt(): chances follow from the ones before, so no logarithm is taken of factorials but the first."""
    lf = lambda k: np.where(k < 16, small[np.minimum(k, 15).astype(np.int64)], (x := np.maximum(k, 1.0) + 0.0) * np.log(x) + 0.5 * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x))
    small = np.log([float(np.prod(np.arange(1.0, k + 1))) for k in range(16)])
    a, b = (v.ravel().astype(float) for v in np.meshgrid(fa, fb, indexing="ij"))
    mean = a * b / n
    spread = 10 * np.sqrt(mean) + 10
    low, high = np.maximum.reduce([np.ones(len(a)), a + b - n, np.floor(mean - spread)]), np.minimum.reduce([a, b, np.ceil(mean + spread)])
    out = np.zeros(len(a))
    order = np.argsort(low - high, kind="stable")
    a, b, met, high = a[order], b[order], low[order], high[order]
    chance = np.exp(lf(a) + lf(b) + lf(n - a) + lf(n - b) - lf(np.full(len(a), n)) - lf(met) - lf(a - met) - lf(b - met) - lf(n - a - b + met))
    room, total, base = high - met + 1, np.zeros(len(a)), np.log2(n / (a * b))
    ends = np.searchsorted(-room, -np.arange(1, int(room[0]) + 1 if len(room) else 1), "right")
    for end in ends.tolist():
        m, on = met[:end], slice(0, end)
        total[on] += m / n * (np.log2(m) + base[on]) * chance[on]
        chance[on] *= (a[on] - m) * (b[on] - m) / ((m + 1) * (n - a[on] - b[on] + m + 1))
        met[on] += 1
    out[order] = total
    return out.reshape(len(fa), len(fb))


#: Parts of the sizes of pages, and of types, that are compared with each other.
SIZES = (64, 8)


def page_mi(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pages and types as how often each size comes; a part of the sizes meets another one as arrays."""

    def each(p: Pages) -> Iterator[list]:
        kinds = max(len(p.words), 1)
        n = np.bincount(p.lang_of[p.page] * kinds + p.word)
        cell = np.flatnonzero(n)
        c = np.unique(p.page * kinds + p.word, return_counts=True)
        size = np.bincount(p.page, minlength=len(p.ids))
        h = np.bincount(c[0] // kinds, c[1] * np.log2(c[1]), len(size)) - size * np.log2(np.maximum(size, 1))
        held, at = np.unique((p.lang_of * (int(size.max(initial=0)) + 1) + size)[size > 0], return_inverse=True)
        most = int(size.max(initial=0)) + 1
        langs = pa.array(p.names, pa.string()).take(pa.array(np.concatenate([cell // kinds, held // most])))
        none = np.zeros(len(cell))
        yield [langs, pa.concat_arrays([p.texts.take(pa.array(cell % kinds)), pa.nulls(len(held), pa.string())]), pa.array(np.concatenate([none.astype(np.int64), held % most])), pa.array(np.concatenate([n[cell], np.bincount(at, minlength=len(held))])), pa.array(np.concatenate([none, np.bincount(at, h[size > 0], len(held))]))]

    rows = over_pages(docs.where("lang is not null"), "lang string, tok string, f bigint, n bigint, h double", each)
    sizes = settled(query(spark, "select lang, kind, f, count(*) as types, sum(n) as pages, sum(h) as h from (select lang, case when tok is null then 0 else 1 end as kind, case when tok is null then f else sum(n) end as f, sum(n) as n, sum(h) as h from {rows} group by lang, tok, f) s group by lang, kind, f", {"rows": rows}))
    listed = lambda kind, m: f"select lang, pmod(hash(f), {SIZES[kind]}) as part, collect_list(f) as f, collect_list({m}) as m from {{sizes}} where kind = {kind} group by lang, pmod(hash(f), {SIZES[kind]})"
    met = query(spark, f"select a.lang, n, a.f as fa, a.m as ma, b.f as fb, b.m as mb from ({listed(0, 'pages')}) a join ({listed(1, 'types')}) b on b.lang = a.lang join (select lang, sum(f * pages) as n from {{sizes}} where kind = 0 group by lang) z on z.lang = a.lang", {"sizes": sizes})
    schema = pa.schema([("lang", pa.string()), ("chance", pa.float64())])

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, float] = {}
            for lang, n, fa, ma, fb, mb in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "fa", "ma", "fb", "mb")), strict=True):
                fa, ma = np.array(fa), np.array(ma, dtype=float)
                for k in range(0, len(fa), 32):
                    for j in range(0, len(fb), 8192):
                        found[lang] = found.get(lang, 0.0) + float(ma[k : k + 32] @ _met_by_chance(float(n), fa[k : k + 32], np.array(fb[j : j + 8192])) @ np.array(mb[j : j + 8192], dtype=float))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts * 4).mapInArrow(chance, "lang string, chance double")
    seen = "select lang, n, greatest(log2(n) + h / n, 0.0e0) as mi from (select lang, sum(case when kind = 0 then f * pages end) as n, sum(case when kind = 0 then h else -types * f * log2(f) end) as h from {sizes} group by lang) s"
    return query(spark, f"select o.lang, o.n, round(mi, 6) as mi, round(chance, 6) as chance, round(mi - chance, 6) as excess from ({seen}) o join (select lang, sum(chance) as chance from {{dealt}} group by lang) e on e.lang = o.lang", {"sizes": sizes, "dealt": dealt})


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words one after another, and how many each has."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64), np.array([len(w) for w in words] or [0], dtype=np.int64)


#: Places of a language's pages that are worked on together; distances that are left out around a page.
TOGETHER, RADII = 256, (0, 10, 30)


def leave_one_out_radius(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pages as packed counts of letter pairs; those that follow each other come together with their neighbours, and meet sums of classes, which are few, as a table."""

    def each(p: Pages) -> Iterator[list]:
        kinds = max(len(p.words), 1)
        letters, size = _letters([f"^{w}$" for w in p.words])
        first = np.cumsum(size) - size
        pair, gram = np.unique((letters[:-1] << 21) | letters[1:], return_inverse=True)
        held = np.flatnonzero((np.bincount(p.page, minlength=len(p.ids)) >= PAGE_WORDS) & np.array([x is not None for x in p.langs], dtype=bool))
        key, c = np.unique(p.page * kinds + p.word, return_counts=True)
        cut = np.searchsorted(key, held * kinds), np.searchsorted(key, (held + 1) * kinds)
        packed, grams = [], []
        for i, j in zip(*(x.tolist() for x in cut), strict=True):
            word = key[i:j] % kinds
            m = size[word] - 1
            at = np.repeat(first[word] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            n = np.bincount(gram[at], np.repeat(c[i:j], m), len(pair))
            met = np.flatnonzero(n)
            packed.append(zlib.compress(pair[met].tobytes() + n[met].astype(np.int64).tobytes(), 1))
            grams.append(int(n.sum()))
        yield [pa.array(p.ids[held]), pa.array([p.langs[k] for k in held.tolist()], pa.string()), p.sources.take(pa.array(held)), pa.array(np.ones(len(held), dtype=np.int64)), pa.array(grams, pa.int64()), pa.array(packed, pa.binary())]

    def shares(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        pair, n = np.frombuffer(zlib.decompress(packed), dtype=np.int64).reshape(2, -1)
        return pair, np.sqrt(n / n.sum())

    pages = settled(over_pages(docs, "doc_id bigint, lang string, source string, n bigint, grams bigint, packed binary", each))
    types = pa.schema([("lang", pa.string()), ("source", pa.string()), ("pair", pa.int64()), ("x", pa.float64()), ("k", pa.int64())])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of shares by class; pair -1: its pages."""
        held: dict[tuple, list[tuple]] = {}
        for batch in batches:
            for lang, source, packed in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "packed")), strict=True):
                held.setdefault((lang, source), []).append(shares(packed))
            for (lang, source), found in held.items():
                pair, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                x = np.bincount(at, np.concatenate([y for _, y in found]))
                zero = pa.array(np.zeros(len(pair) + 1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(zero), pa.array([source], pa.string()).take(zero), pa.array(np.append(-1, pair)), pa.array(np.append(0.0, x)), pa.array(np.append(len(found), np.zeros(len(pair), dtype=np.int64)))], schema=types)
            held.clear()

    model: dict[str, dict[str | None, tuple[list[int], list[float], int]]] = {}
    sums = pages.mapInArrow(classes, "lang string, source string, pair bigint, x double, k bigint").groupBy("lang", "source", "pair").agg(F.sum("x").alias("x"), F.sum("k").alias("k"))
    for lang, source, pair, x, k in sums.toLocalIterator():
        own = model.setdefault(lang, {}).setdefault(source, [[], [], 0])
        if pair < 0:
            own[2] = k
        else:
            own[0].append(pair)
            own[1].append(x)
    sent = spark.sparkContext.broadcast(model)
    placed = _offset(spark, pages.select("doc_id", "lang", "source", "n", "packed"), "").selectExpr("lang", "source", "start as r", "packed", f"explode(sequence(greatest(0, floor((start - {RADII[-1] + 1}) / {TOGETHER})), floor((start + {RADII[-1] + 1}) / {TOGETHER}))) as block")
    out = pa.schema([("lang", pa.string()), ("radius", pa.int64()), *((c, pa.int64()) for c in ("n", "good", "others", "near_good"))])

    def told(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lang, block = key[0].as_py(), int(key[1].as_py())
        group = group.sort_by("r")
        r, source, found = group.column("r").to_numpy(), group.column("source").to_pylist(), [shares(x) for x in group.column("packed").to_pylist()]
        listed = sorted(x for x in sent.value[lang] if x is not None)
        pair = np.unique(np.concatenate([x for x, _ in found]))
        table, means = np.zeros((len(r), len(pair))), np.zeros((len(listed), len(pair)))
        for k, (x, y) in enumerate(found):
            table[k, np.searchsorted(pair, x)] = y
        for k, name in enumerate(listed):
            x, y = (np.array(v) for v in sent.value[lang][name][:2])
            at = np.minimum(np.searchsorted(pair, x), len(pair) - 1)
            on = pair[at] == x
            means[k, at[on]] = y[on]
        size = np.array([sent.value[lang][name][2] for name in listed], dtype=float)
        place = {x: k for k, x in enumerate(listed)}
        cls = np.array([place.get(x, -1) for x in source])
        one = (cls[:, None] == np.arange(len(listed))).astype(float)
        own = np.flatnonzero(r // TOGETHER == block)
        whole, dots, by_place = table[own] @ means.T, table[own] @ table.T, dict(zip(r.tolist(), source, strict=True))
        rows = []
        for radius in RADII if len(own) and len(listed) else ():
            near = np.abs(r[own, None] - r) <= radius
            held, n = (dots * near) @ one, near @ one
            fits = (whole > 0) & (size > n)
            score = np.where(fits, np.round((whole - held) / np.where(fits, size - n, 1), 9), -np.inf)
            best, some = score.argmax(1), fits.sum(1) >= 2
            beside = [by_place[x] if (x := int(k) - radius - 1) in by_place and by_place[x] is not None else by_place.get(int(k) + radius + 1) for k in r[own[some]]]
            mine = [source[k] for k in own[some].tolist()]
            if mine:
                rows.append((lang, radius, len(mine), int((best[some] == cls[own[some]]).sum()), sum(x is not None for x in beside), sum(x is not None and x == y for x, y in zip(beside, mine, strict=True))))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, out.types, strict=True)], schema=out)

    rows = placed.groupBy("lang", "block").applyInArrow(told, "lang string, radius bigint, n bigint, good bigint, others bigint, near_good bigint")
    common = "select lang, max(k) * 1.0e0 / sum(k) as share from (select lang, source, count(*) as k from {pages} group by lang, source) s group by lang"
    return query(spark, f"select r.lang, cast(radius as int) as radius, sum(n) as pages, round(sum(good) * 1.0e0 / sum(n), 6) as right_share, round(sum(near_good) * 1.0e0 / nullif(sum(others), 0), 6) as nearest_share, round(max(share), 6) as common_share from {{rows}} r join ({common}) c on c.lang = r.lang group by r.lang, radius", {"rows": rows, "pages": pages})


def t7a_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Marks are found where pages lie; types alone travel, and are scored by a table of letters in threes."""

    def marks(p: Pages) -> Iterator[list]:
        kinds, size = max(len(p.words), 1), np.array([len(w) for w in p.words] or [0], dtype=np.int64)
        keys = lambda mark, x: [b"%s%d:%d:%d" % (mark, *y) for y in zip(p.ids[p.page[x]].tolist(), p.line[x].tolist(), p.pos[x].tolist(), strict=True)]
        x = np.flatnonzero(_u(keys(b"t7", np.arange(len(p.at)))) < edits.MARKED)
        off, length = np.floor(_u(keys(b"t7o", x)) * (size[p.word[x]] + 1)).astype(np.int64), size[p.word[x]]
        place = np.select([(off == 0) & (p.pos[x] > 0), off == 0, off == 1, off == length], [0, 1, 2, 3], 4)
        word = np.where(place == 0, p.word[np.maximum(x - 1, 0)], p.word[x])
        marked = np.zeros(p.room, dtype=bool)
        marked[p.at[x]] = True
        left = np.flatnonzero(~marked[p.at])
        cell, n = np.unique(np.concatenate([(p.lang_of[p.page[left]] * 6 + 5) * kinds + p.word[left], (p.lang_of[p.page[x]] * 6 + place) * kinds + word]), return_counts=True)
        yield [pa.array(p.names, pa.string()).take(pa.array(cell // kinds // 6)), pa.array(["boundary", "before", "initial", "final", "internal", None]).take(pa.array(cell // kinds % 6)), p.texts.take(pa.array(cell % kinds)), pa.array(n)]

    found = over_pages(docs.where("lang is not null"), "lang string, position string, tok string, n bigint", marks)
    met = settled(found.groupBy("lang", "position", "tok").agg(F.sum("n").alias("n")))
    both = query(spark, "select lang, tok, sum(case when position is null then n else 0 end) as n, max(case when position is null then 0 else 1 end) as named from {met} group by lang, tok", {"met": met})

    def threes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of marked words in threes as numbers, one word after another, and how many each has."""
        letters, size = _letters([f"^^{w}$" for w in words])
        row = np.repeat(np.arange(len(size)), np.maximum(size - 2, 0))
        at = np.arange(len(row)) + 2 * row
        return (((letters[at] << 21) | letters[at + 1]) << 21) | letters[at + 2], (size - 2)[: len(words)]

    kinds = pa.schema([("lang", pa.string()), ("c2", pa.string()), ("c1", pa.string()), ("s", pa.string()), ("k2", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            key, size = threes(batch.column("tok").to_pylist())
            of, n = np.repeat(langs.indices.to_numpy(), size), np.repeat(batch.column("n").to_numpy(), size)
            for g, lang in enumerate(langs.dictionary.to_pylist()):
                three, at = np.unique(key[of == g], return_inverse=True)
                k = np.bincount(at, n[of == g], len(three)).astype(np.int64)
                text = [chr(x >> 42) + chr(x >> 21 & 0x1FFFFF) + chr(x & 0x1FFFFF) for x in three.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(k), dtype=np.int64))), pa.array([x[:2] for x in text], pa.string()), pa.array([x[1] for x in text], pa.string()), pa.array([x[2] for x in text], pa.string()), pa.array(k)], schema=kinds)

    k2 = settled(both.mapInArrow(counted, "lang string, c2 string, c1 string, s string, k2 bigint").groupBy("lang", "c2", "c1", "s").agg((F.sum("k2") * F.lit(1.0)).alias("k2")))
    p0, p1 = "(k0 + 1.0e0) / (n0 + v0)", "(k1 + p0) / (n1 + 1)"
    model = query(spark, f"""with letters as (select lang, s, sum(k2) as k0 from {{k2}} group by lang, s), sizes as (select lang, sum(k0) as n0, count(*) + 1 as v0 from letters where k0 > 0 group by lang),
        cells as (select k.lang, k.c2, k.s, k.k2, sum(k.k2) over (partition by k.lang, k.c2) as n2, sum(k.k2) over (partition by k.lang, k.c1, k.s) as k1, sum(k.k2) over (partition by k.lang, k.c1) as n1, k0, n0, v0 from {{k2}} k join letters l on l.lang = k.lang and l.s = k.s join sizes z on z.lang = k.lang)
        select lang, c2, s, log2((k2 + {p1}) / (n2 + 1)) as b from (select *, {p0} as p0 from cells) c""", {"k2": k2})
    bits: dict[str, tuple[list[int], list[float]]] = {}
    for lang, c2, letter, b in model.toLocalIterator():
        own = bits.setdefault(lang, ([], []))
        own[0].append((((ord(c2[0]) << 21) | ord(c2[1])) << 21) | ord(letter))
        own[1].append(b)
    tables = {lang: (np.array(k)[o := np.argsort(k)], np.array(b)[o]) for lang, (k, b) in bits.items()}
    sent = spark.sparkContext.broadcast(tables)
    told = pa.schema([("lang", pa.string()), ("tok", pa.string()), ("n", pa.int64()), ("named", pa.int32()), ("len", pa.int64()), ("lp", pa.float64())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            # a language without a word outside marked lines has no model
            batch = batch.filter(pa.array([x in sent.value for x in langs]))
            coded = batch.column("lang").dictionary_encode()
            key, size = threes(batch.column("tok").to_pylist())
            of, b = np.repeat(coded.indices.to_numpy(), size), np.zeros(len(key))
            for g, lang in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(of == g)
                listed, value = sent.value[lang]
                b[own] = value[np.searchsorted(listed, key[own])]
            row = np.repeat(np.arange(batch.num_rows), size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "tok", "n", "named")), pa.array(size - 1), pa.array(np.bincount(row, b, batch.num_rows).astype(float))], schema=told)

    scored = both.mapInArrow(scores, "lang string, tok string, n bigint, named int, len bigint, lp double")
    binned = settled(query(spark, "select *, cast(floor(lp * 16) as bigint) as bin from (select lang, tok, n, named, len, round(lp, 9) as lp from {scored}) s", {"scored": scored}))
    base = "select lang, sum(n) as initial_, sum(case when length(tok) > 1 then n else 0 end) as final_, sum(greatest(0, length(tok) - 2) * n) as internal_ from {met} where position is null group by lang"
    tested = " union all ".join(f"select e.lang, '{k}' as position, sum(case when e.position = '{k}' then e.n else 0 end) as k, sum(e.n) as n, max({k}_ * 1.0e0 / (initial_ + final_ + internal_)) as p from events e join base b on b.lang = e.lang group by e.lang" for k in ("initial", "internal", "final"))
    return query(spark, f"""with events as (select * from {{met}} where position is not null), base as ({base}),
        hist as (select lang, len, bin, sum(sum(n)) over (partition by lang, len order by bin) - sum(n) as before, sum(sum(n)) over (partition by lang, len) as total from {{binned}} group by lang, len, bin),
        ranked as (select x.lang, x.tok, (max(before) + sum(case when y.lp <= x.lp then y.n else 0 end)) * 1.0e0 / nullif(max(total), 0) as pct from (select * from {{binned}} where named = 1) x join {{binned}} y on y.lang = x.lang and y.len = x.len and y.bin = x.bin join hist h on h.lang = x.lang and h.len = x.len and h.bin = x.bin group by x.lang, x.tok),
        median_ as (select e.lang, sum(case when pct is not null then e.n else 0 end) as scored, percentile(pct, 0.5, e.n) as pct from events e join ranked r on r.lang = e.lang and r.tok = e.tok group by e.lang),
        tested as ({tested}), tails as ({edits._binomial_tails(SPARK, 'select * from tested', 'lang, position')})
        select t.lang, t.position, cast(t.n as bigint) as events, cast(t.k as bigint) as k, round(t.k * 1.0e0 / t.n, 6) as share, round(t.p, 6) as base, round(p_greater, 6) as p_greater, round(least(1.0e0, 2 * least(p_greater, 1 - p_greater + p_here)), 6) as p_two_sided, scored, round(pct, 6) as median_percentile
        from tested t join tails on tails.lang = t.lang and tails.position = t.position left join median_ m on m.lang = t.lang""", {"met": met, "binned": binned})


#: Plans that have such a form.
PAGED: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {f.__name__: f for f in (
    e1_graded, t1_line_break, page_cosine, space_gain, t2a_difference, window_percentiles, poured_text, pmi_by_edit_distance, collocations, page_mi, leave_one_out_radius, t7a_edits,
)}
