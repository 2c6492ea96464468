"""Statistics of pages on arrays: a batch of whole pages is cut into numbers, and tasks return sums alone.

No row is made for a word, so nothing is joined, sorted or shuffled. Each row of documents is a page here; tables where
doc_ids come twice or are null are left to the plans' SQL, which puts rows of one id together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.dialect import SPARK, poisson_ends
from glyphmill.functions.lineage import settled
from glyphmill.operators.distances import Edits
from glyphmill.operators import pairs
from glyphmill.operators.hashing import by_digest, digests, numbered
from glyphmill.plans.information import SHUFFLES, dealt, mi
from glyphmill.sources.corpus import WORD, query

#: Bytes of a batch of pages.
BATCH_BYTES = 4 << 20
#: Lines of two pages are so far apart at least in the running number of lines.
GAP = 16


class Pages:
    """Words of some pages in their order. page, line (in the page), pos, n_line and at (running number of the line) by word; word: its place in words."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("words")
        coded = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        self.ids, self.langs = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("lang").to_pylist()
        self.sources: pa.StringArray = batch.column("source")
        self.texts: pa.StringArray = coded.dictionary
        self.words: list[str] = self.texts.to_pylist()
        codes, page = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        ends = codes == (self.words.index("\n") if "\n" in self.words else -1)
        below = np.cumsum(ends)
        lines = np.bincount(page, ends, len(sizes)).astype(np.int64)
        line = below - np.repeat(np.cumsum(lines) - lines, sizes)
        self.lines = lines + 1
        base = np.cumsum(self.lines + GAP) - self.lines
        self.page, self.line, self.word = page[~ends], line[~ends], codes[~ends]
        self.at = base[self.page] + self.line
        self.room = int(self.lines.sum()) + GAP * (len(sizes) + 2)
        self.count = np.bincount(self.at, minlength=self.room)
        self.first = np.cumsum(self.count) - self.count
        self.pos = np.arange(len(self.at)) - self.first[self.at]
        self.n_line = self.count[self.at]
        self.names = list(dict.fromkeys(self.langs))
        at = {k: i for i, k in enumerate(self.names)}
        self.lang_of = np.array([at[k] for k in self.langs], dtype=np.int64)

    def numbers(self, feature: Callable[[str], str]) -> tuple[np.ndarray, list[str]]:
        """A feature of each word as a number, and the features by number."""
        known: dict[str, int] = {}
        by_word = np.array([known.setdefault(feature(w), len(known)) for w in self.words] or [0], dtype=np.int64)
        return by_word[self.word], list(known)


def alone(docs: DataFrame) -> bool:
    """No id comes twice, and none is null."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def over_pages(docs: DataFrame, schema: str, f: Callable[[Pages], Iterator[tuple | list]], sums: int = 0) -> DataFrame:
    """Rows that f gives for each batch of pages: lists of columns, or, with sums, rows whose last so many columns a task adds up by the others."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    types = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in schema.split(", ")])

    def table(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not sums:
                for columns in f(Pages(batch)):
                    yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns, types.types, strict=True)], schema=types)
                continue
            for row in f(Pages(batch)):
                key, values = row[:-sums], row[-sums:]
                held[key] = [x + y for x, y in zip(held[key], values, strict=True)] if key in held else list(values)
        if held:
            yield table([(*k, *v) for k, v in held.items()])

    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD.replace("{{", "{").replace("}}", "}") + r"|\n"), F.lit(0))
    return docs.where("text is not null").select("doc_id", "lang", "source", words.alias("words")).mapInArrow(run, schema)


def types_of(docs: DataFrame) -> DataFrame:
    """Types of a language with their counts."""

    def each(p: Pages) -> Iterator[list]:
        kinds = max(len(p.words), 1)
        n = np.bincount(p.lang_of[p.page] * kinds + p.word)
        cell = np.flatnonzero(n)
        yield [pa.array(p.names, pa.string()).take(pa.array(cell // kinds)), p.texts.take(pa.array(cell % kinds)), pa.array(n[cell])]

    return over_pages(docs, "lang string, tok string, n bigint", each).groupBy("lang", "tok").agg(F.sum("n").alias("n"))


def _repeats(key: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sorted different numbers, places of pairs that are low to high apart."""
    left = np.arange(len(key))
    for step in range(1, high + 1):
        left = left[: np.searchsorted(left, len(key) - step)]
        gap = key[left + step] - key[left]
        left, gap = left[gap <= high], gap[gap <= high]
        if not len(left):
            return
        x = left[gap >= low]
        yield x, x + step


def e4_line_drift(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        key, c = np.unique(p.word * p.room + p.at, return_counts=True)
        c = c.astype(float)
        at = key % p.room
        norm = np.bincount(at, c * c, p.room)
        dots, met = np.zeros(p.room * 9), np.zeros(p.room * 9, dtype=bool)
        for x, y in _repeats(key, 2, 8):
            cell = at[x] * 9 + at[y] - at[x]
            dots += np.bincount(cell, c[x] * c[y], len(dots))
            met[cell] = True
        lang = np.zeros(p.room, dtype=np.int64)
        lang[p.at] = p.lang_of[p.page]
        cell = np.flatnonzero(met)
        line, k = cell // 9, cell % 9
        cos, group = dots[cell] / np.sqrt(norm[line] * norm[line + k]), lang[line] * 9 + k
        n, s = np.bincount(group), np.bincount(group, cos)
        for g in np.flatnonzero(n):
            yield p.names[g // 9], int(g % 9), int(n[g]), float(s[g])

    rows = over_pages(docs, "lang string, k bigint, n bigint, cos double", sums, 2)
    return query(spark, "select lang, round(regr_slope(cos, k), 6) as slope, round(regr_intercept(cos, k), 6) as intercept, count(*) as n from (select lang, k, sum(cos) / sum(n) as cos from {rows} group by lang, k) q group by lang", {"rows": rows})


def t4b_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        u, _ = p.numbers(lambda w: w[:1] + w[-1:])
        inner = np.flatnonzero((p.pos > 0) & (p.pos < p.n_line - 1))
        at, pos, own, lang = p.at[inner], p.pos[inner], u[inner], p.lang_of[p.page[inner]]
        for k in (1, 2, 3):
            n, first = p.count[at + k], p.first[at + k]
            for off in range(-2, 3):
                to = pos + off
                x = np.flatnonzero((to > 0) & (to < n - 1))
                same = own[x] == u[first[x] + to[x]]
                for g, (m, h) in enumerate(zip(np.bincount(lang[x], minlength=len(p.names)), np.bincount(lang[x], same, len(p.names)), strict=True)):
                    if m:
                        yield p.names[g], k, int(off == 0), int(m), int(h)

    rows = over_pages(docs, "lang string, k bigint, aligned bigint, n bigint, hits bigint", sums, 2)
    means = "select lang, k, sum(case when aligned = 1 then hits end) * 1.0e0 / sum(case when aligned = 1 then n end) as a, sum(case when aligned = 0 then hits end) * 1.0e0 / sum(case when aligned = 0 then n end) as b from {rows} group by lang, k"
    return query(spark, f"select lang, k, round(a, 6) as aligned, round(b, 6) as beside, round(a / nullif(b, 0.0e0), 6) as ratio from ({means}) m", {"rows": rows})


#: Lags of T4a, and its draws of pages.
LAGS, DEALS = range(2, 9), 200


def t4a_errors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        last, kinds = p.numbers(lambda w: w[-1:])
        long = p.n_line >= 3
        key, c = np.unique(p.at[long] * len(kinds) + last[long], return_counts=True)
        same = np.bincount(key // len(kinds), c * (c - 1.0), p.room)
        first = np.flatnonzero(long & (p.pos == 0))
        n, page = p.n_line[first], p.page[first]
        share = same[p.at[first]] / (n * (n - 1.0))
        h, e = [], []
        for k in LAGS:
            x = np.flatnonzero(long & (p.pos + k < p.n_line))
            h.append(np.bincount(p.page[x], last[x] == last[x + k], len(p.ids)))
            e.append(np.bincount(page, np.maximum(n - k, 0) * share, len(p.ids)))
        held = np.unique(page)
        values, lang = np.stack([*h, *e], axis=1)[held], p.lang_of[held]
        for rep in range(DEALS + 1):
            drawn = values
            if rep:
                u = (digests(np.array([b"t4%d:%d" % (rep, x) for x in p.ids[held].tolist()])) >> np.uint64(32))[:, 0] / 4294967296.0
                drawn = values * np.searchsorted(poisson_ends(), u, side="right")[:, None]
            for g in np.unique(lang):
                yield p.names[g], rep, *drawn[lang == g].sum(0).tolist()

    columns = ", ".join(f"{c}{k} double" for c in "he" for k in LAGS)
    rows = over_pages(docs, f"lang string, rep bigint, {columns}", sums, 2 * len(LAGS))
    ratios = "select lang, rep, " + ", ".join(f"sum(h{k}) / nullif(sum(e{k}), 0.0e0) as r{k}" for k in LAGS) + " from {rows} group by lang, rep"
    by_lag = f"select lang, rep, k, r from ({ratios}) s lateral view stack({len(LAGS)}, {', '.join(f'{k}, r{k}' for k in LAGS)}) t as k, r"
    return query(spark, f"select lang, k, round(max(case when rep = 0 then r end), 6) as ratio, round(stddev_samp(case when rep > 0 then r end), 6) as se from ({by_lag}) z group by lang, k", {"rows": rows})


def e1_boundary_recency(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Classes are numbers from 0 to 8; a cell is a page, whether lines differ, and two classes."""

    def sums(p: Pages) -> Iterator[tuple]:
        pages, cls = len(p.ids), np.minimum(p.pos, 2) * 3 + np.minimum(p.n_line - 1 - p.pos, 2)
        x_part = p.page * 162 + cls * 9
        cell = lambda x, y: x_part[x] + cls[y] + 81 * (p.at[x] != p.at[y])
        seen, hits = np.zeros(pages * 162), np.zeros(pages * 162)
        every = np.arange(len(cls))
        for k in range(2, 41):
            x = every[:-k][p.page[k:] == p.page[:-k]]
            seen += np.bincount(cell(x, x + k), minlength=len(seen))
        place = every + p.page * 41
        room = int(place[-1]) + 42 if len(place) else 1
        key = np.sort(p.word * room + place)
        own = key % room
        at = np.zeros(room, dtype=np.int64)
        at[place] = every
        for x, y in _repeats(key, 2, 40):
            hits += np.bincount(cell(at[own[x]], at[own[y]]), minlength=len(hits))
        group, k = np.unique((p.page * len(p.words) + p.word) * 9 + cls, return_counts=True)
        words, row = np.unique(group // 9, return_inverse=True)
        table = np.zeros((len(words), 9))
        table[row, group % 9] = k
        page = words // max(len(p.words), 1)
        n = np.stack([np.bincount(page, table[:, c], pages) for c in range(9)], axis=1)
        share = np.zeros((pages, 9, 9))
        for a in range(9):
            for b in range(9):
                same = np.bincount(page, table[:, a] * (table[:, b] - (a == b)), pages)
                of = n[:, a] * (n[:, b] - (a == b))
                share[:, a, b] = np.divide(same, of, out=np.zeros(pages), where=of > 0)
        seen, hits = seen.reshape(pages, 2, 9, 9), hits.reshape(pages, 2, 9, 9)
        due = (seen * share[:, None]).sum((2, 3))
        for g, name in enumerate(p.names):
            mine = p.lang_of == g
            for kind, label in enumerate(("same_line", "cross_line")):
                if m := int(seen[mine, kind].sum()):
                    yield name, label, m, float(hits[mine, kind].sum()), float(due[mine, kind].sum())

    rows = over_pages(docs, "lang string, kind string, pairs bigint, hits double, due double", sums, 3)
    return query(spark, "select lang, kind, cast(sum(pairs) as bigint) as pairs, round(sum(hits) / nullif(sum(due), 0.0e0), 6) as ratio from {rows} group by lang, kind", {"rows": rows})


def _ranks(texts: list[str]) -> np.ndarray:
    """Of each text its place in their order."""
    out = np.empty(len(texts), dtype=np.int64)
    out[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    return out


def _counted(p: Pages, page: np.ndarray, a: np.ndarray, b: np.ndarray, left: list[str], right: list[str], *more) -> Iterator[tuple]:
    n = np.bincount((p.lang_of[page] * len(left) + a) * len(right) + b)
    cell = np.flatnonzero(n)
    for c, m in zip(cell.tolist(), n[cell].tolist(), strict=True):
        yield p.names[c // (len(left) * len(right))], *more, left[c // len(right) % len(left)], right[c % len(right)], m


def _dealt_cells(docs: DataFrame, lags: tuple[int, ...], scopes: tuple[str, ...], reps: int) -> DataFrame:
    """Counts c of last and first letters (a, b) of words some places apart in a line: as they stand (scope 'seen', rep 0), and with b dealt anew inside pages or lines."""

    def sums(p: Pages) -> Iterator[tuple]:
        (a, left), (b, right) = p.numbers(lambda w: w[-1:]), p.numbers(lambda w: w[:1])
        inner = np.flatnonzero(p.pos + lags[0] < p.n_line)
        keys = np.array([b"s0:%d:%d:%d" % x for x in zip(p.ids[p.page[inner]].tolist(), p.line[inner].tolist(), p.pos[inner].tolist(), strict=True)], dtype="S")
        by_text = _ranks([f"{x}:" for x in range(int(p.line.max(initial=0)) + 1)])[p.line], _ranks([f"{x}" for x in range(int(p.pos.max(initial=0)) + 1)])[p.pos]
        for k in lags:
            held = np.flatnonzero(p.pos[inner] + k < p.n_line[inner])
            x = inner[held]
            yield from _counted(p, p.page[x], a[x], b[x + k], left, right, k, "seen", 0)
            for name in scopes:
                scope = p.page[x] if name == "page" else p.at[x]
                one = x[np.lexsort((by_text[1][x], by_text[0][x], scope))]
                for rep in range(reps):
                    yield from _counted(p, p.page[one], a[one], b[x[by_digest(numbered(keys[held], 1, rep), scope)] + k], left, right, k, name, rep)

    rows = over_pages(docs, "lang string, d bigint, scope string, rep bigint, a string, b string, n bigint", sums, 1)
    return rows.groupBy("lang", "d", "scope", "rep", "a", "b").agg((F.sum("n") * F.lit(1.0)).alias("c"))


def _excess(by: str, cells: str, where: str, drawn: str) -> str:
    """excess() of counted cells."""
    of = lambda condition, more: f"select lang, {more} a, b, c from {cells} where {condition}"
    return f"""select o.lang, o.n, round(o.mi, 6) as mi, round(e.mi, 6) as chance, round(o.mi - e.mi, 6) as excess from ({mi('', 'lang', of(f"{where} and {by}", ''))}) o
        join (select lang, avg(mi) as mi from ({mi('', 'lang, rep', of(f"{where} and {drawn}", 'rep,'))}) r group by lang) e on o.lang = e.lang"""


def best_above(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def near(p: Pages) -> Iterator[list]:
        def columns(kind: str, x: np.ndarray, others: list[np.ndarray]) -> list:
            langs = pa.array(p.names, pa.string()).take(pa.array(p.lang_of[p.page[x]]))
            return [langs, pa.array([kind]).take(pa.array(np.zeros(len(x), dtype=np.int64))), *(p.texts.take(pa.array(np.append(p.word, 0)[y], mask=y < 0)) for y in (x, *others))]

        to = [p.pos + off for off in (-1, 0, 1)]
        others = [np.where((t >= 0) & (t < p.count[p.at - 1]), p.first[p.at - 1] + t, -1) for t in to]
        x = np.flatnonzero(np.maximum.reduce(others) >= 0)
        yield columns("above", x, [y[x] for y in others])
        keys = np.array([b"v%d:%d:%d" % y for y in zip(p.ids[p.page].tolist(), p.line.tolist(), p.pos.tolist(), strict=True)], dtype="S")
        order = by_digest(keys, p.page)
        i = np.flatnonzero((p.page[order[:-3]] == p.page[order[3:]]) & (p.line[order[:-3]] > 0))
        yield columns("page", order[i], [order[i + k] for k in (1, 2, 3)])

    least = ", ".join(SPARK.edits("a", f"b{k}") for k in (1, 2, 3))
    rows = over_pages(docs, "lang string, kind string, a string, b1 string, b2 string, b3 string", near)
    return query(spark, f"select lang, kind, cast(ed as bigint) as ed, count(*) as n from (select lang, kind, least({least}, 6) as ed from {{rows}}) q group by lang, kind, ed", {"rows": rows})


#: First bits of a digest, by which words are dealt to cells, and those of them that make a bucket of the plan. The 64 bits after them put words of a cell in order.
CELL, BUCKET = 9, 8


def _near(ed: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    """By groups: pairs, the sum of their distances, and those at most 0, 1 and 2 apart."""
    return [np.bincount(by), np.bincount(by, ed), *(np.bincount(by, ed <= k) for k in (0, 1, 2))]


def _compared(docs: DataFrame, prefix: bytes, pairs_of: Callable[[Pages, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]], name: str, share: tuple[int, ...]) -> DataFrame:
    """(lang, relation, n, mean_ed, shares p0, ... at most so far apart) of pairs of words by their relation: those of pairs_of inside pages, and words that follow each other in a language's order of hashes, as name.

    Relations inside pages are counted where pages lie; pairs_of gets the words' hashes too. Words of a language travel
    in cells of the order of their hashes, packed; cells that follow each other are tied by their ends.
    """
    counts = "n bigint, ed bigint, d0 bigint, d1 bigint, d2 bigint"

    def inside(p: Pages) -> Iterator[list]:
        edits, lang = Edits(p.words), p.lang_of[p.page]
        hashed = digests(np.array([prefix + b"%d:%d:%d" % x for x in zip(p.ids[p.page].tolist(), p.line.tolist(), p.pos.tolist(), strict=True)], dtype="S"))
        found = [(p.names[g], relation, *row) for relation, (x, y) in pairs_of(p, hashed).items() for g, row in enumerate(zip(*(c.tolist() for c in _near(edits.of(p.word[x], p.word[y]), lang[x])), strict=True)) if row[0]]
        names, relations, *sums = zip(*found, strict=True) if found else [()] * 7
        none = pa.nulls(len(found), pa.binary())
        yield [pa.array(names, pa.string()), pa.array(relations, pa.string()), pa.array([-1] * len(found), pa.int64()), *(pa.array([int(v) for v in c], pa.int64()) for c in sums), none, none]
        cell, key = (hashed[:, 0] >> np.uint64(64 - CELL)).astype(np.int64) + (lang << CELL), (hashed[:, 0] << np.uint64(CELL)) | (hashed[:, 1] >> np.uint64(64 - CELL))
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        ends = [*starts[1:].tolist(), len(order)]
        words = [p.words[w] for w in p.word[order].tolist()]
        texts = ["\n".join(words[a:b]).encode() for a, b in zip(starts.tolist(), ends, strict=True)]
        keys = [key[order[a:b]].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
        own, n = cell[order[starts]], pa.array(np.diff([*starts.tolist(), len(order)]))
        zero = pa.array(np.zeros(len(own), dtype=np.int64))
        packed = [pa.compress(t, "zstd", asbytes=True) for t in texts]
        yield [pa.array(p.names, pa.string()).take(pa.array(own >> CELL)), pa.array([name]).take(zero), pa.array(own & ((1 << CELL) - 1)), n, pa.array([len(t) for t in texts], pa.int64()), zero, zero, zero, pa.array(keys, pa.binary()), pa.array(packed, pa.binary())]

    ends = "first string, last string"
    schema = f"lang string, relation string, cell bigint, {counts}"
    types = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in f"{schema}, {ends}".split(", ")])

    def tied(group: pa.Table) -> pa.Table:
        """The words of a cell against those that follow, with its first and its last; counts as they come."""
        cell = group.column("cell")[0].as_py()
        if cell < 0:
            return group.select(types.names[:-2]).append_column("first", pa.nulls(len(group), pa.string())).append_column("last", pa.nulls(len(group), pa.string())).cast(types)
        key = np.concatenate([np.frombuffer(k.as_py(), dtype=np.uint64) for k in group.column("keys")])
        texts = pa.array([pa.decompress(t.as_py(), size, "zstd", asbytes=True) for t, size in zip(group.column("words"), group.column("ed").to_pylist(), strict=True)], pa.string())
        coded = pc.split_pattern(texts, "\n").flatten().dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)[np.argsort(key, kind="stable")]
        listed = coded.dictionary.to_pylist()
        ed = Edits(listed).of(word[:-1], word[1:])
        sums = [len(ed), int(ed.sum()), *(int((ed <= k).sum()) for k in (0, 1, 2))]
        return pa.Table.from_pylist([dict(zip(types.names, (group.column("lang")[0].as_py(), name, cell, *sums, listed[word[0]], listed[word[-1]]), strict=True))], schema=types)

    rows = over_pages(docs, f"{schema}, keys binary, words binary", inside).groupBy("lang", "cell").applyInArrow(tied, f"{schema}, {ends}")
    sums = ", ".join(f"sum({c}) as {c}" for c in ("n", "ed", "d0", "d1", "d2"))
    buckets = f"select lang, relation, {sums}, array_sort(collect_list(case when cell >= 0 then struct(cell, first, last) end)) as cells from {{rows}} group by lang, relation, case when cell >= 0 then cell div {1 << CELL - BUCKET} end"
    gaps = "select lang, relation, n, ed, d0, d1, d2, transform(slice(cells, 2, greatest(size(cells) - 1, 0)), (c, i) -> levenshtein(cells[i].last, c.first)) as gaps from {buckets}".replace("{buckets}", f"({buckets}) b")
    of = lambda k: f"round(sum(d{k} + size(filter(gaps, x -> x <= {k}))) * 1.0e0 / sum(n + size(gaps)), 6) as p{k}"
    return query(docs.sparkSession, f"select lang, relation, sum(n + size(gaps)) as n, round(sum(ed + aggregate(gaps, 0, (s, x) -> s + x)) * 1.0e0 / sum(n + size(gaps)), 6) as mean_ed, {', '.join(map(of, share))} from ({gaps}) g group by lang, relation having sum(n + size(gaps)) > 0", {"rows": rows})


def vertical_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def pairs_of(p: Pages, hashed: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((hashed[:, 1], hashed[:, 0], p.page))
        beside = np.flatnonzero(p.page[order[:-1]] == p.page[order[1:]])
        out = {"before": (x := np.flatnonzero(p.pos > 0), x - 1), "same_page": (order[beside], order[beside + 1])}
        for name, up, off in (("above", 1, 0), ("above_left", 1, -1), ("above_right", 1, 1), ("two_above", 2, 0)):
            to = p.pos + off
            x = np.flatnonzero((to >= 0) & (to < p.count[p.at - up]))
            out[name] = x, p.first[p.at[x] - up] + to[x]
        return out

    return _compared(docs, b"v", pairs_of, "same_language", (0, 1, 2))


def adjacency_distance(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def pairs_of(p: Pages, hashed: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {str(k): (x := np.flatnonzero(p.pos + k < p.n_line), x + k) for k in (1, 2, 5)}

    return _compared(docs, b"ad", pairs_of, "0", (0, 1)).selectExpr("lang", "cast(relation as int) as gap", "n", "mean_ed", "p0", "p1")


#: Words of a page that has a profile.
PROFILE_WORDS = 200


def _profiles(docs: DataFrame) -> DataFrame:
    """First letters of pages of PROFILE_WORDS words and more, and how often each comes, packed."""

    def each(p: Pages) -> Iterator[list]:
        letter, letters = p.numbers(lambda w: w[:1])
        cell, n = np.unique(p.page * len(letters) + letter, return_counts=True)
        page = cell // max(len(letters), 1)
        long = np.flatnonzero(np.bincount(page, n, len(p.ids)) >= PROFILE_WORDS)
        ends = np.searchsorted(page, long), np.searchsorted(page, long, "right")
        parts = [slice(a, b) for a, b in zip(*(x.tolist() for x in ends), strict=True)]
        symbols = ["".join(letters[k] for k in (cell[x] % len(letters)).tolist()) for x in parts]
        yield [pa.array(p.ids[long]), pa.array([p.langs[k] for k in long.tolist()], pa.string()), p.sources.take(pa.array(long)), pa.array(symbols, pa.string()), pa.array([n[x].astype(np.int64).tobytes() for x in parts], pa.binary())]

    return settled(over_pages(docs, "doc_id bigint, lang string, source string, symbols string, counts binary", each))


def _by_relation(docs: DataFrame, roots: bool) -> DataFrame:
    """(relation, n, s): pairs of pages of a source that share a letter, by whether they share the language, and the sum of their distances."""
    schema = pa.schema([("relation", pa.string()), ("n", pa.int64()), ("s", pa.float64())])

    def sums(source: str, a: pairs.Shares, b: pairs.Shares, same: bool) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(2, dtype=np.int64), np.zeros(2)
        known = {k: i for i, k in enumerate(dict.fromkeys(x for x in a.langs + b.langs if x is not None))}
        left, right = np.array([known.get(x, -1) for x in a.langs]), np.array([known.get(x, -2) for x in b.langs])
        for i, j, value in pairs.strips(a, b, same, roots):
            one = (left[i] == right[j]).astype(np.int64)
            n += np.bincount(one, minlength=2)
            s += np.bincount(one, np.sqrt(np.maximum(0.0, 2 - 2 * value)) if roots else value, 2)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(["other", "same"]).take(pa.array(met)), pa.array(n[met]), pa.array(s[met])], schema=schema)

    return pairs.in_blocks(_profiles(docs), sums, "relation string, n bigint, s double")


def hellinger(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return query(spark, "select relation, sum(n) as pairs, round(sum(s) / sum(n), 6) as distance from {rows} group by relation", {"rows": _by_relation(docs, True)})


def jsd_by_relation(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return query(spark, "select relation, sum(n) as pairs, round(sum(s) / sum(n), 6) as jsd from {rows} group by relation", {"rows": _by_relation(docs, False)})


#: Decimals of a divergence, and how the matrix is best written, where the session does not say: its rows are as many as pairs, and values so various that Parquet tells only in a long first page that they come again.
PLACES, WRITTEN = 6, {"spark.sql.parquet.compression.codec": "zstd", "parquet.page.size": str(4 << 20), "parquet.dictionary.page.size": str(16 << 20), "parquet.page.row.count.limit": str(4 << 20)}


def _rounded(x: np.ndarray) -> np.ndarray:
    """As SQL rounds, by decimal digits, halves upwards."""
    scaled = x * 10.0**PLACES
    out = np.floor(scaled + 0.5)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[k] = int(Decimal(repr(float(x[k]))).scaleb(PLACES).quantize(Decimal(1), ROUND_HALF_UP))
    return out / 10.0**PLACES


def page_jsd_matrix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    schema = pa.schema([("source", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("jsd", pa.float64())])
    for key, value in WRITTEN.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)

    def rows(source: str, a: pairs.Shares, b: pairs.Shares, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, value in pairs.strips(a, b, same, False, listed=True):
            x, y = a.ids[i], b.ids[j]
            yield pa.RecordBatch.from_arrays([pa.array([source]).take(pa.array(np.zeros(len(x), dtype=np.int64))), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(_rounded(value))], schema=schema)

    return pairs.in_blocks(_profiles(docs), rows, "source string, i bigint, j bigint, jsd double")


#: What neighbours may agree in.
FEATURES: dict[str, Callable[[str], str]] = {
    "first1": lambda w: w[:1], "first2": lambda w: w[:2], "last1": lambda w: w[-1:], "last2": lambda w: w[-2:], "whole": lambda w: w, "length": lambda w: str(len(w)), "ends": lambda w: w[:1] + w[-1:],
}


def agreement(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        long, x = np.flatnonzero(p.n_line >= 2), np.flatnonzero(p.pos + 1 < p.n_line)
        lang = p.lang_of[p.page]
        by_line = np.zeros(p.room, dtype=np.int64)
        by_line[p.at] = lang
        n = np.bincount(lang[x], minlength=len(p.names))
        for name, f in FEATURES.items():
            code, kinds = p.numbers(f)
            key, k = np.unique(p.at[long] * max(len(kinds), 1) + code[long], return_counts=True)
            at = key // max(len(kinds), 1)
            hits, due = np.bincount(lang[x], code[x] == code[x + 1], len(p.names)), np.bincount(by_line[at], k * (k - 1.0) / p.count[at], len(p.names))
            for g in np.flatnonzero(n):
                yield p.names[g], name, int(n[g]), float(hits[g]), float(due[g])

    rows = over_pages(docs, "lang string, feature string, n bigint, hits double, due double", sums, 3)
    return query(spark, "select lang, feature, sum(n) as n, round(sum(hits) / nullif(sum(due), 0.0e0), 6) as ratio from {rows} group by lang, feature", {"rows": rows})


SEEN = "scope = 'seen'"


def _kept(cells: DataFrame) -> DataFrame:
    """Cells are few, and statistics read them several times."""
    return settled(cells)


def excess_mi_by_distance(spark: SparkSession, docs: DataFrame) -> DataFrame:
    cells = _kept(_dealt_cells(docs, (1, 2, 3), ("page", "line"), 1))
    parts = []
    for k in (1, 2, 3):
        seen = f"select lang, a, b, c from {{cells}} where d = {k} and scope = 'seen'"
        parts.append(f"select {k} as d, 'language' as scope, o.lang, o.n, round(o.mi, 6) as mi, round(e.mi, 6) as chance, round(o.mi - e.mi, 6) as excess from ({mi('', 'lang', seen)}) o join ({dealt('', 'lang', SPARK, seen)}) e on o.lang = e.lang")
        parts += [f"select {k} as d, '{scope}' as scope, lang, n, mi, chance, excess from ({_excess(SEEN, '{cells}', f'd = {k}', f'scope = {scope!r}')}) x" for scope in ("page", "line")]
    return query(spark, " union all ".join(parts), {"cells": cells})


def excess_mi_page(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return query(spark, _excess(SEEN, "{cells}", "d = 1", "scope = 'page'"), {"cells": _kept(_dealt_cells(docs, (1,), ("page",), SHUFFLES))})


def over_under_pairs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    sums = f"select lang, a, b, cast(sum(case when scope = 'seen' then c end) as bigint) as c, sum(case when scope = 'line' and lang is not null then c end) / {SHUFFLES}.0e0 as e from {{cells}} group by lang, a, b"
    return query(spark, f"select lang, a, b, c as n, round(coalesce(e, 0.0e0), 6) as chance, round((c - coalesce(e, 0.0e0)) / sqrt(coalesce(e, 0.0e0) + 1), 6) as z from ({sums}) s where c >= 8", {"cells": _dealt_cells(docs, (1,), ("line",), SHUFFLES)})


def excess_mi_line(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def sums(p: Pages) -> Iterator[tuple]:
        (a, left), (b, right) = p.numbers(lambda w: w[-1:]), p.numbers(lambda w: w[:1])
        x = np.flatnonzero(p.pos + 1 < p.n_line)
        keys = np.array([b"ls0:%d:%d:%d" % y for y in zip(p.ids[p.page].tolist(), p.line.tolist(), p.pos.tolist(), strict=True)], dtype="S")
        for rep in range(SHUFFLES + 1):
            order = by_digest(numbered(keys, 2, rep), p.at) if rep else np.arange(len(keys))
            yield from _counted(p, p.page[x], a[order[x]], b[order[x + 1]], left, right, rep)

    rows = over_pages(docs, "lang string, rep bigint, a string, b string, n bigint", sums, 1)
    cells = _kept(rows.groupBy("lang", "rep", "a", "b").agg((F.sum("n") * F.lit(1.0)).alias("c")))
    told = mi("", "lang, rep", "select lang, rep, a, b, c from {cells}")
    seen, chance = "max(case when rep = 0 then mi end)", "avg(case when rep > 0 then mi end)"
    return query(spark, f"select lang, max(case when rep = 0 then n end) as n, round({seen}, 6) as mi, round({chance}, 6) as chance, round({seen} - {chance}, 6) as excess from ({told}) r group by lang", {"cells": cells})


#: Words of pages whose repeats count, and distances of these.
LEAST_WORDS, REPEATS = 10, (2, 40)


def _recency(docs: DataFrame) -> DataFrame:
    """Repeats by distance, and what pages' counts give."""
    low, high = REPEATS

    def sums(p: Pages) -> Iterator[tuple]:
        size = np.bincount(p.page, minlength=len(p.ids))
        every = np.flatnonzero(size[p.page] >= LEAST_WORDS)
        place = every + p.page[every] * (high + 1)
        room = int(place[-1]) + high + 2 if len(place) else 1
        key = np.sort(p.word[every] * room + place)
        lang = np.zeros(room, dtype=np.int64)
        lang[place] = p.lang_of[p.page[every]]
        hits, due = (np.zeros(len(p.names) * (high + 1)) for _ in range(2))
        for x, y in _repeats(key, low, high):
            hits += np.bincount(lang[key[x] % room] * (high + 1) + key[y] - key[x], minlength=len(hits))
        kinds = max(len(p.words), 1)
        cell, k = np.unique(p.page[every] * kinds + p.word[every], return_counts=True)
        long = np.flatnonzero(size >= LEAST_WORDS)
        share = np.bincount(cell // kinds, k * (k - 1.0), len(size))[long] / (size[long] * (size[long] - 1.0))
        for dist in range(low, high + 1):
            due += np.bincount(p.lang_of[long] * (high + 1) + dist, np.maximum(size[long] - dist, 0) * share, len(due))
        for g in np.unique(p.lang_of[long]).tolist():
            for dist in range(low, high + 1):
                at = g * (high + 1) + dist
                yield p.names[g], dist, float(hits[at]), float(due[at])

    return over_pages(docs, "lang string, dist bigint, hits double, due double", sums, 2)


#: A language that is null meets no repeats in the plan's join.
_RATIOS = "select lang, dist, case when lang is null then 0.0e0 else sum(hits) end / nullif(sum(due), 0.0e0) as ratio from {rows} group by lang, dist"


def t6a_recency(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return query(spark, f"select lang, dist, round(ratio, 6) as ratio from ({_RATIOS}) r", {"rows": _recency(docs)})


def t6a_decay(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return query(spark, f"select lang, round(avg(case when dist <= 5 then ratio end) - avg(case when dist >= 21 then ratio end), 6) as decay from ({_RATIOS}) r group by lang", {"rows": _recency(docs)})


def _spread_words(docs: DataFrame) -> DataFrame:
    """Words (n) by language, source and type, and pairs of one page (o); where tok is null, words of pages and twice their pairs."""

    def each(p: Pages) -> Iterator[list]:
        source = p.sources.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        _, first, of = np.unique(p.lang_of * (source.max(initial=0) + 1) + source, return_index=True, return_inverse=True)
        kinds = max(len(p.words), 1)
        key, k = np.unique(p.page * kinds + p.word, return_counts=True)
        cell, at = np.unique(of[key // kinds] * kinds + key % kinds, return_inverse=True)
        size = np.bincount(p.page, minlength=len(p.ids))
        words = np.bincount(of, size, len(first))
        held = np.flatnonzero(words)
        page = pa.array(first[np.concatenate([cell // kinds, held])])
        n, o = np.concatenate([np.bincount(at, k, len(cell)), words[held]]), np.concatenate([np.bincount(at, k * (k - 1.0), len(cell)) / 2, np.bincount(of, size * (size - 1.0), len(first))[held]])
        yield [pa.array(p.langs, pa.string()).take(page), p.sources.take(page), pa.concat_arrays([p.texts.take(pa.array(cell % kinds)), pa.nulls(len(held), pa.string())]), pa.array(n.astype(np.int64)), pa.array(o)]

    rows = over_pages(docs, "lang string, source string, tok string, n bigint, o double", each)
    return settled(rows.groupBy("lang", "source", "tok").agg(F.sum("n").alias("n"), F.sum("o").alias("o")))


#: Types of a language and source, and the share of its pairs of words that are of one page.
_SPREAD = "g as (select lang, source, tok, n, o from {sums} where tok is not null), f as (select lang, source, o / nullif(n * (n - 1.0e0), 0.0e0) as f from {sums} where tok is null)"


def e5_burstiness(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = f"""with {_SPREAD}, total as (select tok, sum(n) as n, sum(o) as o from g group by tok), e as (select g.tok, sum(g.n * (g.n - 1.0e0) / 2 * f.f) as e from g join f on g.lang = f.lang and g.source = f.source group by g.tok)
        select case when n < 2 then 'H' when n < 5 then 'R' when n < 20 then 'M' when n < 100 then 'F' else 'VF' end as band, round(sum(t.o) / nullif(sum(e.e), 0.0e0), 6) as b from total t join e on e.tok = t.tok where t.n >= 2 group by 1"""
    return query(spark, text, {"sums": _spread_words(docs)})


def e5_gap(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = f"""with {_SPREAD}, total as (select tok, sum(n) as n from g group by tok having sum(n) >= 2 and sum(n) < 100),
        b as (select g.source, sum(case when t.n < 5 then g.o end) as orare, sum(case when t.n < 5 then g.n * (g.n - 1.0e0) / 2 * f.f end) as erare, sum(case when t.n >= 20 then g.o end) as ofreq, sum(case when t.n >= 20 then g.n * (g.n - 1.0e0) / 2 * f.f end) as efreq from g join f on g.lang = f.lang and g.source = f.source join total t on t.tok = g.tok group by g.source),
        s as (select sum(orare) as orare, sum(erare) as erare, sum(ofreq) as ofreq, sum(efreq) as efreq, count(*) as k from b),
        l as (select ln((s.orare - coalesce(b.orare, 0.0e0)) / (s.erare - coalesce(b.erare, 0.0e0))) - ln((s.ofreq - coalesce(b.ofreq, 0.0e0)) / (s.efreq - coalesce(b.efreq, 0.0e0))) as v, ln(s.orare / s.erare) - ln(s.ofreq / s.efreq) as full_, s.k from b join s on s.k > 1),
        mean as (select avg(v) as mean_ from l)
        select count(*) as groups, round(max(full_), 6) as gap, round(sqrt((max(k) - 1.0e0) / max(k) * sum((v - mean_) * (v - mean_))), 6) as se from l join mean on 1 = 1"""
    return query(spark, text, {"sums": _spread_words(docs)})


#: Most frequent words of a language that a device draws every PHASE-th place from, and PHASE. Tokens that the words of a part of a language's list stand for, about, unless one word has more.
TOP, PHASE, PART_TOKENS = 10, 5, 1 << 20


def _listed(types: DataFrame) -> DataFrame:
    """Types of languages, the most frequent first, in parts that follow each other: (lang, n and first: of the part's first word, runs: different counts and how many words have them, size, words)."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("first", pa.string()), ("runs", pa.binary()), ("size", pa.int64()), ("words", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, n, words = batch.column("lang").dictionary_encode().indices.to_numpy(), batch.column("n").to_numpy(), batch.column("tok").to_pylist()
            starts = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff((np.cumsum(n) - n) // PART_TOKENS, prepend=-1) != 0)).tolist()
            rows = []
            for low, high in zip(starts, [*starts[1:], len(n)], strict=True):
                kinds, sizes = np.unique(-n[low:high], return_counts=True)
                text = "\n".join(words[low:high]).encode()
                rows.append((batch.column("lang")[low].as_py(), int(n[low]), words[low], np.stack([-kinds, sizes]).astype(np.int64).tobytes(), len(text), pa.compress(text, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return settled(types.orderBy("lang", F.desc("n"), "tok").mapInArrow(pack, "lang string, n bigint, first string, runs binary, size bigint, words binary"))


class Drawn:
    """A language's words as places of a list: how many there are of each count, and where the parts of the list begin."""

    def __init__(self, parts: list[tuple[int, np.ndarray]]):
        """parts: the number and the runs of each, in order."""
        runs = np.concatenate([x for _, x in parts], axis=1)
        self.n, upto = runs[0], np.cumsum(runs[0] * runs[1])
        self.upto, self.from_, self.place = upto, upto - runs[0] * runs[1], np.cumsum(runs[1]) - runs[1]
        self.words, self.total = int(runs[1].sum()), int(upto[-1])
        self.ids = np.array([k for k, _ in parts])
        sizes = np.array([int(x[1].sum()) for _, x in parts])
        self.starts = np.cumsum(sizes) - sizes
        left = np.minimum(runs[1], np.maximum(TOP - self.place, 0))
        self.top = int((left * runs[0]).sum())

    def places(self, x: np.ndarray) -> np.ndarray:
        """Places of the words that own numbers below total."""
        run = np.searchsorted(self.upto, x, "right")
        return self.place[run] + (x - self.from_[run]) // self.n[run]


def device_text(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Places of drawn words follow from how many words have each count; counts of places travel packed to the parts of the list, which have the words."""
    listed = _listed(types_of(docs).where("lang is not null"))
    found = sorted(((lang, -n, first.encode(), runs) for lang, n, first, runs in listed.select("lang", "n", "first", "runs").toLocalIterator()), key=lambda x: x[:3])
    number = {(lang, -n, first.decode()): k for k, (lang, n, first, _) in enumerate(found)}
    by_lang: dict[str, list[tuple[int, np.ndarray]]] = {}
    for k, (lang, _, _, runs) in enumerate(found):
        by_lang.setdefault(lang, []).append((k, np.frombuffer(runs, dtype=np.int64).reshape(2, -1)))
    models = spark.sparkContext.broadcast({lang: Drawn(parts) for lang, parts in by_lang.items()})
    schema = "part bigint, lang string, cells binary, times binary, size bigint, words binary"

    def draw(p: Pages) -> Iterator[list]:
        keys = np.array([b"dv%d:%d:%d" % x for x in zip(p.ids[p.page].tolist(), p.line.tolist(), p.pos.tolist(), strict=True)], dtype="S")
        u, phase, lang = (digests(keys)[:, 0] >> np.uint64(32)) / 4294967296.0, p.pos % PHASE, p.lang_of[p.page]
        rows = []
        for g, name in enumerate(p.names):
            if (m := models.value.get(name)) is None:
                continue
            # with fewer words than TOP the plan draws nothing there
            if not len(own := np.flatnonzero((lang == g) & ((phase > 0) | (m.words >= TOP)))):
                continue
            x = np.floor(u[own] * np.where(phase[own] == 0, m.top, m.total)).astype(np.int64)
            cell, times = np.unique(m.places(x) * PHASE + phase[own], return_counts=True)
            part = np.searchsorted(m.starts, cell // PHASE, "right") - 1
            cell = (cell - m.starts[part] * PHASE).astype(np.int32)
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for low, high in zip(starts, [*starts[1:], len(cell)], strict=True):
                rows.append((int(m.ids[part[low]]), name, np.diff(cell[low:high], prepend=np.int32(0)).tobytes(), times[low:high].astype(np.int32).tobytes()))
        parts, names, cells, times = zip(*rows, strict=True) if rows else [()] * 4
        packed = [[pa.compress(x, "zstd", asbytes=True) for x in c] for c in (cells, times)]
        yield [pa.array(parts, pa.int64()), pa.array(names, pa.string()), *(pa.array(c, pa.binary()) for c in packed), pa.array([len(x) for x in cells], pa.int64()), pa.nulls(len(rows), pa.binary())]

    def numbered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [number[x] for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "first")), strict=True)]
            none = pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column("lang"), none, none, batch.column("size"), batch.column("words")], names=[c.split()[0] for c in schema.split(", ")])

    types = pa.schema([("lang", pa.string()), ("phase", pa.int64()), ("tok", pa.string()), ("n", pa.int64())])

    def told(group: pa.Table) -> pa.Table:
        """How often each word of a part was drawn in each phase."""
        held = group.filter(group.column("words").is_valid())
        words = pa.array(pa.decompress(held.column("words")[0].as_py(), held.column("size")[0].as_py(), "zstd", asbytes=True).decode().split("\n"), pa.string())
        n = np.zeros(len(words) * PHASE, dtype=np.int64)
        drawn = group.filter(group.column("words").is_null())
        for cells, times, size in zip(*(drawn.column(c).to_pylist() for c in ("cells", "times", "size")), strict=True):
            cell, k = (np.frombuffer(pa.decompress(x, size, "zstd", asbytes=True), dtype=np.int32) for x in (cells, times))
            n[np.cumsum(cell)] += k
        met = np.flatnonzero(n)
        return pa.Table.from_arrays([held.column("lang").combine_chunks().take(pa.array(np.zeros(len(met), dtype=np.int64))), pa.array(met % PHASE), words.take(pa.array(met // PHASE)), pa.array(n[met])], schema=types)

    rows = over_pages(docs, schema, draw).unionByName(listed.mapInArrow(numbered_parts, schema))
    return rows.groupBy("part").applyInArrow(told, "lang string, phase bigint, tok string, n bigint")


#: Tokens of a language that a sample holds, and parts in which they are sought.
FIRST, PARTS = 100, 64


def keyed_sample(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def each(p: Pages) -> Iterator[list]:
        keys = np.array([b"s%d:%d:%d" % x for x in zip(p.ids[p.page].tolist(), p.line.tolist(), p.pos.tolist(), strict=True)], dtype="S")
        u, lang = (digests(keys)[:, 0] >> np.uint64(32)) / 4294967296.0, p.lang_of[p.page]
        tenth, held = [], []
        for g in range(len(p.names)):
            own = np.flatnonzero(lang == g)
            tenth.append(int((u[own] < 0.1).sum()) if len(own) else None)
            # those that are as near as the last one come too: ties go by key
            held.append(own[u[own] <= np.partition(u[own], FIRST - 1)[FIRST - 1]] if len(own) > FIRST else own)
        x, none = np.concatenate(held or [np.zeros(0, dtype=np.int64)]), len(tenth)
        size = np.array([len(w) for w in p.words] or [0])
        langs = pa.array(p.names, pa.string()).take(pa.array(np.concatenate([np.arange(none), lang[x]])))
        yield [langs, pa.array(tenth + [None] * len(x), pa.int64()), pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(size[p.word[x]])]), pa.concat_arrays([pa.nulls(none, pa.float64()), pa.array(u[x])]), pa.array([None] * none + [k.decode() for k in keys[x].tolist()], pa.string())]

    rows = settled(over_pages(docs, "lang string, tenth bigint, letters bigint, u double, k_ string", each))
    some = f"select lang, slice(array_sort(collect_list(struct(u, k_, letters))), 1, {FIRST}) as xs from {{rows}} where k_ is not null group by lang, pmod(hash(k_), {PARTS})"
    first = f"select lang, aggregate(slice(array_sort(flatten(collect_list(xs))), 1, {FIRST}), 0L, (s, x) -> s + x.letters) as letters from ({some}) s group by lang"
    return query(spark, f"select a.lang, tenth, letters * 1.0e0 as letters from (select lang, sum(tenth) * 1.0e0 as tenth from {{rows}} group by lang) a join ({first}) b on b.lang = a.lang", {"rows": rows})


def _grams(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Letter groups of each word, ends marked, as numbers: how many, which, and the groups by number."""
    known: dict[str, int] = {}
    counts = np.array([len(w) + 3 - size if w != "\n" else 0 for w in words] or [0], dtype=np.int64)
    flat = [known.setdefault(m[i : i + size], len(known)) for w in words if w != "\n" for m in (f"^{w}$",) for i in range(len(w) + 3 - size)]
    return counts, np.array(flat, dtype=np.int64), list(known)


def _of_sources(p: Pages) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Sources in order, and types with their counts by source: where it is null, its place is behind the last."""
    listed = p.sources.to_pylist()
    names = sorted({x for x in listed if x is not None})
    at, kinds = {x: i for i, x in enumerate(names)}, max(len(p.words), 1)
    n = np.bincount(np.array([at.get(x, len(names)) for x in listed], dtype=np.int64)[p.page] * kinds + p.word)
    cell = np.flatnonzero(n)
    return names, cell // kinds, cell % kinds, n[cell]


def _alone_in_source(docs: DataFrame) -> DataFrame:
    """(size_, b, tok, n): types of a source with a letter group that no other source has. Groups are found in one pass, their words in a second."""

    def spans(p: Pages) -> Iterator[list]:
        names, source, word, _ = _of_sources(p)
        known = source < len(names)
        source, word = source[known], word[known]
        for size in (2, 3):
            counts, flat, grams = _grams(p.words, size)
            gram, row = _spread_grams(counts, flat, word)
            low, high = np.full(len(grams), -1), np.full(len(grams), -1)
            low[gram[::-1]] = source[row[::-1]]
            high[gram] = source[row]
            met = np.flatnonzero(low >= 0)
            texts, listed = pa.array(grams, pa.string()), pa.array(names, pa.string())
            yield [pa.array(np.full(len(met), size)), texts.take(pa.array(met)), listed.take(pa.array(low[met])), listed.take(pa.array(high[met]))]

    met = over_pages(docs, "size_ bigint, g string, low string, high string", spans).groupBy("size_", "g").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
    held: dict[int, set[str]] = {2: set(), 3: set()}
    for size, g in met.select("size_", "g").toLocalIterator():
        held[size].add(g)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def types(p: Pages) -> Iterator[list]:
        names, source, word, n = _of_sources(p)
        listed = pa.concat_arrays([pa.array(names, pa.string()), pa.nulls(1, pa.string())])
        for size in (2, 3):
            counts, flat, grams = _grams(p.words, size)
            alone = np.array([g in sent.value[size] for g in grams], dtype=bool)
            gram, row = _spread_grams(counts, flat, np.arange(len(p.words)))
            own = np.flatnonzero(np.bincount(row, alone[gram], len(counts))[word] > 0)
            yield [pa.array(np.full(len(own), size)), listed.take(pa.array(source[own])), p.texts.take(pa.array(word[own])), pa.array(n[own])]

    return over_pages(docs, "size_ bigint, b string, tok string, n bigint", types).groupBy("size_", "b", "tok").agg(F.sum("n").alias("n"))


def _spread_grams(counts: np.ndarray, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of words, one after another, and each one's place in word."""
    start, row = np.cumsum(counts) - counts, np.repeat(np.arange(len(word)), counts[word])
    return flat[start[word[row]] + np.arange(len(row)) - np.repeat(np.cumsum(counts[word]) - counts[word], counts[word])], row


def deviant_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A batch tells letter groups that several of its pages have, and the words of those that one has."""

    def each(p: Pages) -> Iterator[list]:
        kinds = max(len(p.words), 1)
        key, k = np.unique(p.page * kinds + p.word, return_counts=True)
        page, word = key // kinds, key % kinds
        for size in (2, 3):
            counts, flat, grams = _grams(p.words, size)
            gram, row = _spread_grams(counts, flat, word)
            first, last = (np.zeros(len(grams), dtype=np.int64) for _ in range(2))
            first[gram[::-1]] = page[row[::-1]]
            last[gram] = page[row]
            alone, many = np.flatnonzero((first == last)[gram]), np.flatnonzero(first != last)
            held, none = row[alone], len(many)
            texts = pa.array(grams, pa.string()).take(pa.array(np.concatenate([gram[alone], many])))
            yield [pa.array(np.full(len(texts), size)), texts, *(pa.concat_arrays([x, pa.nulls(none, x.type)]) for x in (pa.array(p.ids[page[held]]), p.texts.take(pa.array(word[held])), pa.array(k[held])))]

    pages = over_pages(docs, "size_ bigint, g string, b bigint, tok string, n bigint", each)
    own = "select size_, explode(xs) as x from (select size_, g, min(b) as low, max(b) as high, count(*) - count(b) as more, collect_set(case when b is not null then struct(b, tok, n) end) as xs from {pages} group by size_, g) s where more = 0 and low = high"
    parts = [f"select size_, 'page' as block, x.n as n from (select distinct size_, x from ({own}) o) y", "select size_, 'source' as block, n from {types}"]
    counted = ", ".join(f"{size}L, '{block}', count(case when size_ = {size} and block = '{block}' then n end), round(avg(case when size_ = {size} and block = '{block}' then case when n >= 2 then 1.0e0 else 0.0e0 end end), 6)" for size in (2, 3) for block in ("source", "page"))
    return query(spark, f"select cast(size_ as int) as size_, block, types, recurring from (select stack(4, {counted}) as (size_, block, types, recurring) from ({' union all '.join(parts)}) v) w", {"pages": pages, "types": _alone_in_source(docs)})


#: Plans that have such a form.
PAGED: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {f.__name__: f for f in (
    e4_line_drift, t4b_columns, excess_mi_by_distance, excess_mi_page, e1_boundary_recency, excess_mi_line, over_under_pairs, t4a_errors, best_above, vertical_neighbours,
    hellinger, jsd_by_relation, page_jsd_matrix, agreement, adjacency_distance, t6a_recency, t6a_decay, e5_burstiness, e5_gap, device_text, keyed_sample, deviant_variants,
)}
