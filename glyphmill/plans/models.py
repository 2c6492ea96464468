"""Models of letter sequences, what they say of held-out words, and texts made by rules and hashes."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan

#: Order-2 contexts of words with marked ends: (lang, half, ctx, sym, c).
def counts(d: Spark, k: int, by: str = "lang") -> str:
    return f"select {by}, substr(t, cast(i as int), {k}) as ctx, substr(t, cast(i as int) + {k}, 1) as sym, count(*) as c from (select {by}, concat(repeat('^', {k}), tok, '$') as t, cast(length(tok) as bigint) + 1 as m from {{tk}}) q {d.each('1', 'm', 'i')} group by {by}, 2, 3".replace("group by " + by + ", 2, 3", "group by " + by + f", substr(t, cast(i as int), {k}), substr(t, cast(i as int) + {k}, 1)")


@plan("tk")
def ngram_model(d: Spark) -> str:
    """Letters by the two before them, with the share among letters that follow."""
    return f"select lang, ctx, sym, c, round(c * 1.0e0 / sum(c) over (partition by lang, ctx), 6) as p from ({counts(d, 2)}) q"


@plan("tk")
def pruned_model(d: Spark) -> str:
    """Transitions met three times or more, and all of contexts that have none such."""
    return f"select lang, ctx, sym, c from (select *, max(c) over (partition by lang, ctx) as top from ({counts(d, 2)}) q) z where c >= 3 or top < 3"


def _halves(d: Spark) -> str:
    return f"""h2 as ({counts(d, 2, 'lang, half').replace('{tk}', 'halved')}), m2 as (select lang, ctx, sym, c, sum(c) over (partition by lang, ctx) as n from h2 where half = 0),
        m1 as (select lang, ctx, sym, c, sum(c) over (partition by lang, ctx) as n from (select lang, right(ctx, 1) as ctx, sym, cast(sum(c) as bigint) as c from h2 where half = 0 group by lang, right(ctx, 1), sym) q),
        m0 as (select lang, sym, c, sum(c) over (partition by lang) as n from (select lang, sym, cast(sum(c) as bigint) as c from h2 where half = 0 group by lang, sym) q)"""


PROB = "(0.6e0 * coalesce(m2.c * 1.0e0 / m2.n, 0.0e0) + 0.3e0 * coalesce(m1.c * 1.0e0 / m1.n, 0.0e0) + 0.09e0 * coalesce(m0.c * 1.0e0 / m0.n, 0.0e0) + 0.01e0 / 40)"
JOINS = "left join m2 on t.lang = m2.lang and t.ctx = m2.ctx and t.sym = m2.sym left join m1 on t.lang = m1.lang and right(t.ctx, 1) = m1.ctx and t.sym = m1.sym left join m0 on t.lang = m0.lang and t.sym = m0.sym"


@plan("tk")
def heldout_bits(d: Spark) -> str:
    """Bits a letter on odd pages under a mixture of orders 2, 1 and 0 from even pages."""
    halved = "select lang, doc_id % 2 as half, tok from {tk}"
    return f"with halved as ({halved}), {_halves(d)} select t.lang, cast(sum(t.c) as bigint) as letters, round(-sum(t.c * log2({PROB})) / sum(t.c), 6) as bits from h2 t {JOINS} where t.half = 1 group by t.lang"


@plan("tk")
def word_surprise(d: Spark) -> str:
    """Log-probability of held-out types a letter, and where it ranks among types of the same length."""
    halved = "select lang, doc_id % 2 as half, tok from {tk}"
    odd = f"select lang, tok, substr(t, cast(i as int), 2) as ctx, substr(t, cast(i as int) + 2, 1) as sym from (select lang, tok, concat('^^', tok, '$') as t, cast(length(tok) as bigint) + 1 as m from (select distinct lang, tok from halved where half = 1) o) q {d.each('1', 'm', 'i')}"
    return f"""with halved as ({halved}), {_halves(d)}, s as (select t.lang, t.tok, round(sum(log2({PROB})) / count(*), 9) as lp from ({odd}) t {JOINS} group by t.lang, t.tok)
        select lang, len, count(*) as types, round(avg(lp), 6) as mean_lp, round(avg(case when share <= 0.05e0 then lp end), 6) as odd_lp from (select lang, length(tok) as len, lp, rank() over (partition by lang, length(tok) order by lp) * 1.0e0 / count(*) over (partition by lang, length(tok)) as share from s) r group by lang, len""".replace("select lang, len, count(*)", "select lang, cast(len as bigint) as len, count(*)")


@plan("pr")
def boundary_factors(d: Spark) -> str:
    """How much a word's last letter favours the next one's first: (seen + 0.5) / (expected + 0.5) for all pairs of letters."""
    edge = "select lang, right(a, 1) as a, left(b, 1) as b, count(*) * 1.0e0 as c from {pr} group by lang, right(a, 1), left(b, 1)"
    return f"""with e as ({edge}), x as (select lang, a, sum(c) as ca from e group by lang, a having sum(c) >= 50), y as (select lang, b, sum(c) as cb from e group by lang, b having sum(c) >= 50), n as (select lang, sum(c) as n from e group by lang)
        select x.lang, x.a, y.b, round((coalesce(e.c, 0.0e0) + 0.5e0) / (ca * cb / n + 0.5e0), 6) as factor from x join y on x.lang = y.lang join n on n.lang = x.lang left join e on e.lang = x.lang and e.a = x.a and e.b = y.b"""


@plan("tk")
def lexicon_known(d: Spark) -> str:
    """Share of the words of odd pages that even ones know, by tokens and by types."""
    return "select t.lang, round(sum(case when k.tok is null then 0 else n end) * 1.0e0 / sum(n), 6) as tokens, round(avg(case when k.tok is null then 0.0e0 else 1.0e0 end), 6) as types from (select lang, tok, count(*) as n from {tk} where doc_id % 2 = 1 group by lang, tok) t left join (select distinct lang, tok from {tk} where doc_id % 2 = 0) k on t.lang = k.lang and t.tok = k.tok group by t.lang"


@plan("pr")
def bigrams_known(d: Spark) -> str:
    """Share of word pairs of odd pages that even ones hold."""
    return "select t.lang, count(*) as pairs, round(avg(case when k.a is null then 0.0e0 else 1.0e0 end), 6) as known from (select distinct lang, a, b from {pr} where doc_id % 2 = 1) t left join (select distinct lang, a, b from {pr} where doc_id % 2 = 0) k on t.lang = k.lang and t.a = k.a and t.b = k.b group by t.lang"


@plan("tp")
def poured_text(d: Spark) -> str:
    """The words of each language poured in order into the lines of the next one's pages, again from the start where they run out; what becomes of letters at line ends.

    A word's place in its language is its place on the page after the words of the pages before, counted by blocks of ids:
    no language is one task, and words meet places by equality.
    """
    pages = "select lang, doc_id, cast(floor(doc_id / 4096.0e0) as bigint) as block, count(*) as n from {tp} group by lang, doc_id"
    blocks = "select lang, block, sum(sum(n)) over (partition by lang order by block) - sum(n) as before from pages group by lang, block"
    offsets = "select p.lang, p.doc_id, before + sum(n) over (partition by p.lang, p.block order by doc_id) - n as start from pages p join blocks b on b.lang = p.lang and b.block = p.block"
    return f"""with pages as ({pages}), blocks as ({blocks}), offsets as ({offsets}), sizes as (select lang, sum(n) as total from pages group by lang),
        turn as (select lang, coalesce(lead(lang) over (order by lang), min(lang) over ()) as layout, total from sizes),
        w as (select t.lang, cast(start + idx as bigint) as r, tok, case when pos = n_line - 1 then 1.0e0 else 0.0e0 end as final_ from {{tp}} t join offsets o on o.lang = t.lang and o.doc_id = t.doc_id)
        select x.lang, x.layout, right(s.tok, 1) as sym, count(*) as n, sum(final_) as at_end from (select t.lang, t.layout, cast(w.r % t.total as bigint) as r, final_ from w join turn t on t.layout = w.lang) x join (select lang, r, tok from w) s on s.lang = x.lang and s.r = x.r group by x.lang, x.layout, right(s.tok, 1)"""


@plan("ln")
def grille_text(d: Spark) -> str:
    """Words of table cells that a grille shows, moved a row each line: prefix, middle and suffix from hashes of the cell."""
    part = lambda p, col: f"substr('{p}', cast({d.hash32(f'concat({chr(39)}{p[:2]}{chr(39)}, cast((r + line_no) % 12 as string), {chr(39)}:{chr(39)}, cast((c + {col}) % 9 as string))')} % {len(p) // 2} as int) * 2 + 1, 2)"
    cells = f"select lang, line_no, cast({d.hash32('cast(doc_id as string)')} % 12 as bigint) as r, c from (select doc_id, lang, cast(line_no as bigint) as line_no, cast({d.size('words')} as bigint) - 1 as m from {{ln}}) q {d.each('0', 'm', 'c')}"
    return f"select lang, w, count(*) as n from (select lang, concat({part('thanonreinho', 0)}, {part('erolnest', 1)}, {part('edlyisen', 2)}) as w from ({cells}) z) y group by lang, w"


@plan("tk", "ty")
def device_text(d: Spark) -> str:
    """Words drawn by a hash from a language's frequencies, all of its words; every fifth place of a line is drawn from the ten most frequent words only.

    A word owns the numbers from hi - n to hi; draws meet words by equal 64ths of these, of which each has at most 64 words.
    """
    cum = "select lang, tok, n, r, sum(n) over (partition by lang order by r rows between unbounded preceding and current row) as hi from (select lang, tok, n, row_number() over (partition by lang order by n desc, tok) as r from {ty}) q"
    tops = f"select lang, max(hi) as total, max(case when r = 10 then hi end) as ten from ({cum}) c group by lang"
    key = "concat('dv', cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))"
    spots = f"select t.lang, t.pos % 5 as phase, cast(floor({d.u(key)} * case when t.pos % 5 = 0 then ten else total end) as bigint) as x from (select lang, doc_id, line_no, pos from {{tk}}) t join ({tops}) p on t.lang = p.lang"
    parts = f"select * from (select lang, tok, n, hi, cast(floor((hi - n) / 64.0e0) as bigint) as low, cast(floor((hi - 1) / 64.0e0) as bigint) as high from ({cum}) c) v {d.each('low', 'high', 'part')}"
    return f"select s.lang, s.phase, w.tok, count(*) as n from (select lang, phase, x, cast(floor(x / 64.0e0) as bigint) as part from ({spots}) z) s join ({parts}) w on s.lang = w.lang and s.part = w.part and s.x >= w.hi - w.n and s.x < w.hi group by s.lang, s.phase, w.tok"


@plan("types")
def homophones(d: Spark) -> str:
    """Letters enciphered by signs, as many for a letter as its frequency asks, picked by a hash of the place."""
    letters = f"select tok, n, i, substr(tok, cast(i as int), 1) as sym from (select tok, n, cast(length(tok) as bigint) as m from {{types}}) q {d.each('1', 'm', 'i')}"
    return f"""with l as ({letters}), k as (select sym, greatest(1, cast(round(60.0e0 * n / t) as bigint)) as signs from (select sym, sum(n) as n from l group by sym) z join (select sum(n) as t from l) y on 1 = 1)
        select sign, cast(sum(n) as bigint) as n from (select l.n, concat(l.sym, cast({d.hash32("concat(l.tok, ':', cast(l.i as string))")} % k.signs as string)) as sign from l join k on l.sym = k.sym) y group by sign"""


@plan("tk")
def fit_objective(d: Spark) -> str:
    """How far each source is from the whole in four statistics: sum of squared relative differences, least first."""
    s = "avg(length(tok) * 1.0e0) as a, count(distinct tok) * 1.0e0 / count(*) as b, avg(case when left(tok, 1) in ('a','e','i','o','u') then 1.0e0 else 0.0e0 end) as c, avg(n_line * 1.0e0) as d_"
    return f"select g.lang, g.source, round(pow((g.a - v.a) / v.a, 2) + pow((g.b - v.b) / v.b, 2) + pow((g.c - v.c) / v.c, 2) + pow((g.d_ - v.d_) / v.d_, 2), 6) as objective from (select lang, source, {s} from {{tk}} group by lang, source) g join (select lang, {s} from {{tk}} group by lang) v on g.lang = v.lang"


@plan("documents")
def drift_weights(d: Spark) -> str:
    """Weights of a second model along the pages of a language: rising smoothly, and in one step."""
    return "select doc_id, lang, round((r - 1) / nullif(n - 1.0e0, 0.0e0), 6) as smooth, case when r > n / 2.0e0 then 1.0e0 else 0.0e0 end as step from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as r, count(*) over (partition by lang) as n from {documents}) q"


@plan("tk")
def keyed_sample(d: Spark) -> str:
    """A tenth of the tokens by a hash, and the hundred of each language that it puts first."""
    key = "concat('s', cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))"
    first = f"select lang, sum(length(tok)) as letters from (select lang, tok, row_number() over (partition by lang order by u, k_) as r from (select lang, tok, u, k_ from (select lang, tok, u, k_, row_number() over (partition by lang, substr(k_, length(k_), 1), substr(md5(k_), 32, 1) order by u, k_) as near from t) n where near <= 100) m) z where r <= 100 group by lang"
    return f"with t as (select lang, tok, {d.u(key)} as u, {key} as k_ from {{tk}}) select a.lang, tenth, letters * 1.0e0 as letters from (select lang, sum(case when u < 0.1e0 then 1 else 0 end) * 1.0e0 as tenth from t group by lang) a join ({first}) b on b.lang = a.lang"
