"""Corpus relations: any table of texts, messages or events as lines and tokens of pages.

Each relation is SQL over tables or other relations; on Spark it becomes a DataFrame, and what several queries read
can be given to them as one. Lines and tokens carry their places, as order has a meaning here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.dialect import SPARK, Spark
from glyphmill.sources.chunks import CHUNK_WORDS, hand_chunks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: A natural word: letters and letter-like numbers of a lower-cased line.
WORD = r"[\p{{L}}\p{{Nl}}\p{{No}}]+"

DEFINITIONS: dict[str, Callable[[Spark], str]] = {}
READS: dict[str, tuple[str, ...]] = {}


def relation(*reads: str):
    def keep(f):
        DEFINITIONS[f.__name__], READS[f.__name__] = f, reads
        return f

    return keep


def closure(names: tuple[str, ...]) -> list[str]:
    """Relations needed for names, each after those it reads; tables are left out."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in DEFINITIONS and name not in out:
            for r in READS[name]:
                add(r)
            out.append(name)

    for n in names:
        add(n)
    return out


@relation("documents")
def ln(d: Spark) -> str:
    """Lines of documents, from 0, with their words."""
    return f"""select doc_id, lang, source, line_no, line, {d.find_all("lower(line)", WORD)} as words
        from (select doc_id, lang, source, line_no, line from {{documents}} {d.numbered(d.split("text", chr(92) + "n"), "line_no", "line")}) l"""


@relation("ln")
def lw(d: Spark) -> str:
    """Lines as arrays of their words, without the text."""
    return "select doc_id, lang, source, line_no, words from {ln}"


@relation("lw")
def tk(d: Spark) -> str:
    """Words by page, line and place in the line."""
    return f"""select doc_id, lang, source, line_no, cast({d.size("words")} as bigint) as n_line, pos, tok from {{lw}} {d.numbered("words", "pos", "tok")}"""


@relation("tk")
def tp(d: Spark) -> str:
    """Words with their running place in the page."""
    return "select *, row_number() over (partition by doc_id order by line_no, pos) - 1 as idx from {tk}"


@relation("tk")
def pr(d: Spark) -> str:
    """Neighbouring words of a line: a, then b."""
    return "select * from (select doc_id, lang, source, line_no, pos, tok as a, lead(tok) over (partition by doc_id, line_no order by pos) as b from {tk}) q where b is not null"


@relation("tk")
def ty(d: Spark) -> str:
    """Types of a language with their counts."""
    return "select lang, tok, count(*) as n from {tk} group by lang, tok"


@relation("ty")
def types(d: Spark) -> str:
    """Types of all languages together with their counts."""
    return "select tok, cast(sum(n) as bigint) as n from {ty} group by tok"


@relation("types")
def ed1(d: Spark) -> str:
    """Ordered pairs of types at edit distance 1, and k, the letters before the edit: found through what is left when a letter is deleted."""
    cut = f"select tok, i, concat(substr(tok, 1, i - 1), substr(tok, i + 1)) as del from (select tok, cast(length(tok) as bigint) as len from {{types}}) q {d.each('1', 'len', 'i')}"
    cut = cut.replace("i - 1)", "cast(i as int) - 1)").replace("i + 1)", "cast(i as int) + 1)")
    return f"""select a, b, max(i) - 1 as k from (
        select x.tok as a, y.tok as b, x.i from ({cut}) x join ({cut}) y on x.i = y.i and x.del = y.del and x.tok <> y.tok
        union all select x.tok as a, t.tok as b, x.i from ({cut}) x join {{types}} t on x.del = t.tok
        union all select t.tok as a, x.tok as b, x.i from ({cut}) x join {{types}} t on x.del = t.tok) q group by a, b"""


#: Pages of fewer words have no place in a run. Neighbouring pages of a language that are compared with each other.
PAGE_WORDS, RUN = 100, 32
#: Steps of ln t, half a unit each, over which the floor of a divergence is summed: from -24 to 4.
STEPS = (-48, 8)


def integrand(d: Spark, rows: str) -> str:
    """rows with ni, nj and q, once for each of STEPS as s, with term: the sum of terms over s, halved and in nats, is what one cell adds to the divergence of two draws of ni and nj from a distribution that gives it q, on average.

    The expectation of x ln x for x = X/n with X binomial is an integral over ln t of E[x] exp(-t) - E[x exp(-tx)], whose
    terms have closed forms; those of both draws and their mean together leave one smooth integrand, which even steps sum
    to ten digits. So the floor of a divergence is exact, without draws.
    """
    steps = f"select *, exp(s / 2.0e0) * (ni + nj) as t from ({rows}) h {d.each(f'({STEPS[0]})', str(STEPS[1]), 's')}"
    waned = f"select *, exp(-t / (2 * ni)) as ei, exp(-t / (2 * nj)) as ej from ({steps}) v"
    mixed = f"select *, 1 - q + q * ei as ai, 1 - q + q * ej as aj, 1 - q + q * ei * ei as bi, 1 - q + q * ej * ej as bj from ({waned}) w"
    return f"select *, q / 2 * (ei * power(ai, ni - 1) * power(aj, nj) + ej * power(ai, ni) * power(aj, nj - 1) - ei * ei * power(bi, ni - 1) - ej * ej * power(bj, nj - 1)) as term from ({mixed}) x"


# Relations that a session keeps have no WITH, by which Spark would not know them again.


@relation("tk")
def pw(d: Spark) -> str:
    """Pages of PAGE_WORDS words and more: how many letter pairs their words have, ends marked, and the block of ids that they are in."""
    return f"select lang, source, doc_id, cast(floor(doc_id / 4096.0e0) as bigint) as block, cast(sum(n * (length(tok) + 1)) as double) as grams from (select lang, source, doc_id, tok, count(*) as n from {{tk}} group by lang, source, doc_id, tok) t group by lang, source, doc_id having sum(n) >= {PAGE_WORDS}"


@relation("pw")
def pg(d: Spark) -> str:
    """Those pages in the order of their ids, in runs of RUN pages of a language: run, and place in it from 0.

    Places come from counts by blocks of ids and places inside these, so no language is one task.
    """
    before = "select lang, block, sum(count(*)) over (partition by lang order by block) - count(*) as before from {pw} group by lang, block"
    placed = f"select p.*, before + row_number() over (partition by p.lang, p.block order by doc_id) - 1 as r from {{pw}} p join ({before}) b on b.lang = p.lang and b.block = p.block"
    return f"select lang, source, doc_id, grams, cast(floor(r / {RUN}.0e0) as bigint) as run, cast(r % {RUN} as bigint) as place from ({placed}) q"


@relation("tk", "pg")
def pc(d: Spark) -> str:
    """Letter pairs of those pages with their counts."""
    types = "select p.lang, p.run, p.place, concat('^', t.tok, '$') as w, cast(length(t.tok) + 1 as bigint) as m, n from (select doc_id, tok, count(*) as n from {tk} group by doc_id, tok) t join {pg} p on p.doc_id = t.doc_id"
    return f"select lang, run, place, substr(w, cast(k as int), 2) as g, cast(sum(n) as double) as c from (select * from ({types}) t {d.each('1', 'm', 'k')}) z group by lang, run, place, substr(w, cast(k as int), 2)"


@relation("pg", "pc")
def xs(d: Spark) -> str:
    """Divergence of letter pairs of every two pages of a run, less what two draws from their pooled pairs give on average; that follows from how many pairs have a pooled count of k."""
    pairs = "select a.lang, a.run, a.place as i, b.place as j, a.grams as ni, b.grams as nj from {pg} a join {pg} b on a.lang = b.lang and a.run = b.run and a.place < b.place"
    both = f"""select lang, run, i, j, ni, nj, g, sum(ci) as ci, sum(cj) as cj from (
        select p.lang, p.run, i, j, ni, nj, g, c as ci, 0.0e0 as cj from ({pairs}) p join {{pc}} c on c.lang = p.lang and c.run = p.run and c.place = p.i
        union all select p.lang, p.run, i, j, ni, nj, g, 0.0e0 as ci, c as cj from ({pairs}) p join {{pc}} c on c.lang = p.lang and c.run = p.run and c.place = p.j) u group by lang, run, i, j, ni, nj, g"""
    mean = "(ci / ni + cj / nj)"
    seen = f"case when ci > 0 then ci / ni * log2(2 * ci / ni / {mean}) else 0.0e0 end + case when cj > 0 then cj / nj * log2(2 * cj / nj / {mean}) else 0.0e0 end"
    counted = f"select lang, run, i, j, ni, nj, ci + cj as k, count(*) as m, sum({seen}) / 2 as seen from ({both}) s group by lang, run, i, j, ni, nj, ci + cj"
    return f"select lang, run, i, j, sum(case when s = {STEPS[1]} then seen else 0.0e0 end) - sum(m * term) / 2 / ln(2.0e0) as x from ({integrand(d, f'select *, k / (ni + nj) as q from ({counted}) h')}) x group by lang, run, i, j"


@relation("lw")
def ch(d: Spark) -> str:
    """Lines of whole chunks: sources/chunks.py; the SQL that finds the same ones, one after another, is for the engine that checks it."""
    return f"""with recursive l as (select lang, doc_id, line_no, cast({d.size("words")} as bigint) as n from {{lw}} where {d.size("words")} > 0),
        p as (select *, row_number() over w - 1 as at_, sum(n) over w - n as low, sum(n) over w as high from l window w as (partition by lang order by doc_id, line_no)),
        j as (select a.lang, a.at_, b.at_ + 1 as next_ from p a asof join p b on a.lang = b.lang and a.low + {CHUNK_WORDS} <= b.high),
        r as (select lang, at_ from p where at_ = 0 union all select j.lang, j.next_ from r join j on j.lang = r.lang and j.at_ = r.at_)
        select p.lang, p.doc_id, p.line_no, cast(r.at_ as bigint) as chunk, cast(p.at_ - r.at_ as bigint) as nth from r join j on j.lang = r.lang and j.at_ = r.at_ join p on p.lang = r.lang and p.at_ >= r.at_ and p.at_ < j.next_"""


#: Relations that Spark makes in steps, by functions of those they read.
BUILT: dict[str, Callable[..., DataFrame]] = {"ch": lambda lw: hand_chunks(lw)}


@relation("conversations")
def talk(d: Spark) -> str:
    """Words of conversations: a conversation is a page, a turn a line."""
    return f"select conv_id, turn, role, pos, tok from (select conv_id, turn, role, {d.find_all('lower(text)', WORD)} as words from {{conversations}}) q {d.numbered('words', 'pos', 'tok')}"


@relation("events")
def acts(d: Spark) -> str:
    """Events as tokens: a user is a page, a day a line."""
    return f"select user_id, {d.day('ts')} as line_day, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, event_type as tok, cast({d.json('props', 'k')} as bigint) as k from {{events}}"


@relation("pages")
def markup(d: Spark) -> str:
    """Words of web pages without their tags, scripts and styles."""
    plain = d.replace_all(d.replace_all(d.replace_all("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " "), "&[a-z]+;", " ")
    return f"select page_id, pos, tok from (select page_id, {d.find_all(f'lower({plain})', WORD)} as words from {{pages}}) q {d.numbered('words', 'pos', 'tok')}"


#: Relations that many plans read; a session makes them once for a folder of tables.
SHARED = ("lw", "tk", "ty", "ed1", "pg", "pc", "xs", "ch")
_kept: dict[tuple[str, str, str], DataFrame] = {}


#: Tables whose rows are work to take apart.
TEXTS = ("documents", "conversations", "pages")


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def query(spark: SparkSession, text: str, relations: dict[str, DataFrame]) -> DataFrame:
    """spark.sql() over DataFrames by name. It makes them views and drops these, which takes what they are views of out of
    the cache; so they are views of a filter that lets everything pass."""
    return spark.sql(text, **{name: df.where(F.lit(True)) for name, df in relations.items()})


def frames(spark: SparkSession, sf_dir: str, names: tuple[str, ...], keep: bool = True) -> dict[str, DataFrame]:
    """Tables and relations as DataFrames, by name. With keep, SHARED ones stay in memory, and on disk beyond it, for later calls."""
    found: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name in found:
            return found[name]
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if name not in DEFINITIONS:
            found[name] = _spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        elif key in _kept:
            found[name] = _kept[key]
        else:
            read = {r: get(r) for r in READS[name]}
            found[name] = BUILT[name](**read) if name in BUILT else query(spark, DEFINITIONS[name](SPARK), read)
            if keep and name in SHARED:
                _kept[key] = found[name].persist(StorageLevel.MEMORY_AND_DISK)
        return found[name]

    return {n: get(n) for n in names}


def release(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Give back what frames() keeps of a folder of tables, or of all."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _kept if k[0] == app and sf_dir in (None, k[1])]:
        _kept.pop(key).unpersist()
