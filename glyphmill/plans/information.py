"""Mutual information of neighbours, and what is left of it when chance is taken off."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan


def cells(pairs: str, by: str) -> str:
    """Counts c of pairs (a, b) by group. All that follows is made of these, so that pairs are counted once."""
    return f"select {by}, a, b, count(*) * 1.0e0 as c from ({pairs}) p_ group by {by}, a, b"


def mi(pairs: str, by: str, counted: str = "") -> str:
    """Bits that b tells of a, by group: pairs is SQL with columns a, b and those of by, or counted has their cells. From sums of c log c over cells and both margins."""
    counted = counted or cells(pairs, by)
    return f"""select {by}, cast(sum(n) as bigint) as n, greatest(log2(sum(n)) + sum(h) / sum(n), 0.0e0) as mi from (
        select {by}, sum(c) as n, sum(c * log2(c)) as h from ({counted}) c_ group by {by}
        union all select {by}, 0.0e0, -sum(c * log2(c)) from (select {by}, sum(c) as c from ({counted}) c_ group by {by}, a) a_ group by {by}
        union all select {by}, 0.0e0, -sum(c * log2(c)) from (select {by}, sum(c) as c from ({counted}) c_ group by {by}, b) b_ group by {by}) m_ group by {by}"""


def dealt(pairs: str, by: str, d: Spark, counted: str = "") -> str:
    """What mi() would give on average if b were dealt anew among all rows of a group: exact, without draws.

    The count of a cell is hypergeometric, so its mean part follows from the two margins alone. Margins of one size have
    one value, so work grows with the number of different sizes. Counts over ten standard deviations off are left out.
    """
    keys = by.split(", ")
    same = " and ".join(f"x.{k} = y.{k}" for k in keys)
    with_n = " and ".join(f"x.{k} = t.{k}" for k in keys)
    counted = counted or cells(pairs, by)
    sizes = lambda side: f"select {by}, f, count(*) * 1.0e0 as m from (select {by}, cast(sum(c) as bigint) as f from ({counted}) c_ group by {by}, {side}) f_ group by {by}, f"
    lf = d.ln_factorial
    margins = f"select {', '.join(f'x.{k}' for k in keys)}, x.f as fa, y.f as fb, x.m * y.m as m, n, x.f * 1.0e0 * y.f / n as mean_ from ({sizes('a')}) x join ({sizes('b')}) y on {same} join (select {by}, cast(sum(c) as bigint) as n from ({counted}) c_ group by {by}) t on {with_n}"
    spread = "10 * sqrt(mean_) + 10"
    counts = f"select {by}, fa, fb, m, n, met_, {lf('fa')} + {lf('fb')} + {lf('(n - fa)')} + {lf('(n - fb)')} - {lf('n')} as top from (select *, greatest(1, fa + fb - n, cast(floor(mean_ - ({spread})) as bigint)) as low, least(fa, fb, cast(ceil(mean_ + {spread}) as bigint)) as high from ({margins}) c_) l_ {d.each('low', 'high', 'met_')}"
    return f"select {by}, sum(m * met_ / n * log2(met_ * 1.0e0 * n / (fa * 1.0e0 * fb)) * exp(top - {lf('met_')} - {lf('(fa - met_)')} - {lf('(fb - met_)')} - {lf('(n - fa - fb + met_)')})) as mi from ({counts}) k_ group by {by}"


def over_dealt(pairs: str, by: str, d: Spark) -> str:
    """mi(), what dealing anew gives, and what is beyond that."""
    on = " and ".join(f"o.{k} = e.{k}" for k in by.split(", "))
    return f"select {', '.join(f'o.{k}' for k in by.split(', '))}, o.n, round(o.mi, 6) as mi, round(e.mi, 6) as chance, round(o.mi - e.mi, 6) as excess from ({mi(pairs, by)}) o join ({dealt(pairs, by, d)}) e on {on}"


#: Shuffles of a line, as the analyses have them.
SHUFFLES = 5


def line_pairs(words: str, reps: int, d: Spark, keep: str = "lang") -> str:
    """Neighbours a, b of lines as they stand (rep 0) and shuffled reps times: words is SQL with doc_id, line_no, words and keep. A line stays one row until it is cut in pairs, so nothing is shuffled or joined."""
    key = "concat('ls', cast(rep as string), ':', cast(doc_id as string), ':', cast(line_no as string))"
    lines = f"select {keep}, rep, case when rep = 0 then words else {d.shuffled('words', key)} end as words from ({words}) w_ {d.each('0', str(reps), 'rep')}"
    return f"select {keep}, rep, p_.a as a, p_.b as b from ({lines}) l_ {d.runs('words', 'at_', 'p_')} where p_.b is not null"


def over_shuffled(words: str, a: str, b: str, d: Spark, reps: int = SHUFFLES) -> str:
    """Information between a and b, expressions of neighbours a and b of a line, beyond that of shuffled lines, by language."""
    pairs = f"select lang, rep, {a} as a, {b} as b from ({line_pairs(words, reps, d)}) n_"
    return f"""select lang, max(case when rep = 0 then n end) as n, round(max(case when rep = 0 then mi end), 6) as mi, round(avg(case when rep > 0 then mi end), 6) as chance, round(max(case when rep = 0 then mi end) - avg(case when rep > 0 then mi end), 6) as excess
        from ({mi(pairs, 'lang, rep')}) r_ group by lang"""


def permuted(pairs: str, scope: str, key: str, d: Spark, reps: int = SHUFFLES, keep: str = "lang") -> str:
    """Pairs with b dealt anew among the rows of a scope, of which keep is part, once for each repetition. The deal follows the md5 of the row's key."""
    columns = ", ".join(dict.fromkeys([keep, *scope.split(", ")]))
    rows = f"(select {columns}, rep, a, b, {key} as key_ from ({pairs}) s_ {d.each('0', str(reps - 1), 'rep')}) k_"
    left = f"select {columns}, rep, a, row_number() over (partition by rep, {columns} order by key_) as r from {rows}"
    right = f"select {columns}, rep, b, row_number() over (partition by rep, {columns} order by md5(concat('s', cast(rep as string), ':', key_)), key_) as r from {rows}"
    on = " and ".join(f"x.{c} = y.{c}" for c in ["rep", "r", *columns.split(", ")])
    return f"select x.{keep}, x.rep, x.a, y.b from ({left}) x join ({right}) y on {on}"


def excess(pairs: str, scope: str, key: str, d: Spark, reps: int = SHUFFLES, keep: str = "lang") -> str:
    return f"""select o.{keep}, o.n, round(o.mi, 6) as mi, round(e.mi, 6) as chance, round(o.mi - e.mi, 6) as excess from ({mi(pairs, keep)}) o
        join (select {keep}, avg(mi) as mi from ({mi(permuted(pairs, scope, key, d, reps, keep), f'{keep}, rep')}) r group by {keep}) e on o.{keep} = e.{keep}"""


EDGE = "select lang, doc_id, line_no, pos, right(a, 1) as a, left(b, 1) as b from {pr}"
KEY = "concat(cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))"
@plan("pr")
def boundary_mi(d: Spark) -> str:
    """Bits that a word's last letter tells of the next one's first."""
    return f"select lang, n, round(mi, 6) as mi from ({mi(EDGE, 'lang')}) q"


@plan("pr")
def word_mi(d: Spark) -> str:
    return f"select lang, n, round(mi, 6) as mi from ({mi('select lang, a, b from {pr}', 'lang')}) q"


@plan("pr")
def excess_mi_global(d: Spark) -> str:
    """Boundary information beyond that of words dealt anew over the language, on average over all deals."""
    return over_dealt("select lang, right(a, 1) as a, left(b, 1) as b from {pr}", "lang", d)


@plan("pr")
def excess_mi_page(d: Spark) -> str:
    """The same, dealt anew inside pages."""
    return excess(EDGE, "lang, doc_id", KEY, d)


@plan("lw")
def excess_mi_line(d: Spark) -> str:
    """The same beyond lines whose words are shuffled."""
    return over_shuffled(f"select doc_id, lang, line_no, words from {{lw}} where {d.size('words')} >= 2", "right(a, 1)", "left(b, 1)", d)


@plan("pr")
def mi_projections(d: Spark) -> str:
    """Information between neighbours seen through different parts of them, beyond words dealt anew over the language."""
    sides = {"word_word": ("a", "b"), "last1_first1": ("right(a, 1)", "left(b, 1)"), "last2_first2": ("right(a, 2)", "left(b, 2)"), "last1_word": ("right(a, 1)", "b"), "word_first1": ("a", "left(b, 1)"), "last2_word": ("right(a, 2)", "b"), "word_first2": ("a", "left(b, 2)"), "len_len": ("cast(length(a) as string)", "cast(length(b) as string)")}
    pairs = " union all ".join(f"select lang, '{k}' as side, {x} as a, {y} as b from {{pr}}" for k, (x, y) in sides.items())
    return over_dealt(pairs, "lang, side", d)


@plan("tk")
def mi_by_distance(d: Spark) -> str:
    """Boundary information of words 1 to 5 apart in a line."""
    pairs = " union all ".join(f"select lang, {k} as lag_, right(tok, 1) as a, left(b{k}, 1) as b from leads where b{k} is not null" for k in range(1, 6))
    leads = "select lang, tok, " + ", ".join(f"lead(tok, {k}) over (partition by doc_id, line_no order by pos) as b{k}" for k in range(1, 6)) + " from {tk}"
    return f"with leads as ({leads}) select lang, lag_ as d, n, round(mi, 6) as mi from ({mi(pairs, 'lang, lag_')}) q"


@plan("tk")
def break_and_inner_mi(d: Spark) -> str:
    """Boundary information across line breaks and inside lines."""
    ends = "select lang, doc_id, line_no, max_by(tok, pos) as last, min_by(tok, pos) as first from {tk} where n_line >= 2 group by lang, doc_id, line_no"
    across = f"select lang, 'break' as kind, right(last, 1) as a, left(nxt, 1) as b from (select lang, last, lead(first) over (partition by doc_id order by line_no) as nxt, line_no, lead(line_no) over (partition by doc_id order by line_no) as nl from ({ends}) e) x where nl = line_no + 1"
    inner = "select lang, 'inner' as kind, right(tok, 1) as a, left(nxt, 1) as b from (select lang, tok, lead(tok) over (partition by doc_id, line_no order by pos) as nxt from {tk} where n_line >= 2) y where nxt is not null"
    return f"select lang, kind, n, round(mi, 6) as mi from ({mi(f'{across} union all {inner}', 'lang, kind')}) q"


#: Pairs of words with their counts, those of both words, and of their language, by sums that are joined back: a language is no task of its own.
PAIR_COUNTS = """select p.lang, p.a, p.b, c, ca, cb, n from (select lang, a, b, count(*) * 1.0e0 as c from {pr} group by lang, a, b) p join (select lang, a, count(*) * 1.0e0 as ca from {pr} group by lang, a) x on x.lang = p.lang and x.a = p.a
    join (select lang, b, count(*) * 1.0e0 as cb from {pr} group by lang, b) y on y.lang = p.lang and y.b = p.b join (select lang, count(*) * 1.0e0 as n from {pr} group by lang) z on z.lang = p.lang"""


@plan("pr")
def pmi_by_edit_distance(d: Spark) -> str:
    """What pairs at edit distance 0, 1, 2 and beyond add to the information of neighbours."""
    ed = f"case when a = b then 0 when {d.within('a', 'b', 1)} then 1 when {d.within('a', 'b', 2)} then 2 else 3 end"
    return f"""select lang, cast(ed as bigint) as ed, cast(sum(c) as bigint) as pairs, round(sum(c / n * log2(c * n / (ca * cb))), 6) as part from (
        select lang, {ed} as ed, c, ca, cb, n from ({PAIR_COUNTS}) z) y group by lang, ed"""


@plan("pr")
def collocations(d: Spark) -> str:
    """The 20 pairs of each language, met five times or more, with the most pointwise information."""
    return f"""select lang, a, b, cast(c as bigint) as n, round(score, 6) as score from (select *, row_number() over (partition by lang order by round(score, 6) desc, a, b) as r from (
        select lang, a, b, c, c * log2(c * n / (ca * cb)) as score from ({PAIR_COUNTS}) z where c >= 5) y) x where r <= 20"""


@plan("pr")
def over_under_pairs(d: Spark) -> str:
    """Letter pairs across word boundaries by how far counts are from chance inside lines: (seen - chance) / sqrt(chance + 1)."""
    chance = f"select lang, a, b, count(*) / {SHUFFLES}.0e0 as e from ({permuted(EDGE, 'lang, doc_id, line_no', KEY, d)}) p group by lang, a, b"
    return f"""select o.lang, o.a, o.b, o.c as n, round(coalesce(e.e, 0.0e0), 6) as chance, round((o.c - coalesce(e.e, 0.0e0)) / sqrt(coalesce(e.e, 0.0e0) + 1), 6) as z
        from (select lang, a, b, count(*) as c from ({EDGE}) s group by lang, a, b) o left join ({chance}) e on o.lang = e.lang and o.a = e.a and o.b = e.b where o.c >= 8"""


@plan("tk")
def page_mi(d: Spark) -> str:
    """Information between words and pages, beyond words dealt anew."""
    return over_dealt("select lang, cast(doc_id as string) as a, tok as b from {tk}", "lang", d)


@plan("lineitem")
def category_mi(d: Spark) -> str:
    """Information between two columns of any table: return flags and line numbers by status."""
    return f"select l_linestatus, n, round(mi, 6) as mi from ({mi('select l_linestatus, l_returnflag as a, cast(l_linenumber as string) as b from {lineitem}', 'l_linestatus')}) q"


@plan("acts")
def event_mi(d: Spark) -> str:
    """Information between an event and the next of the same user, by distance."""
    leads = "select tok, " + ", ".join(f"lead(tok, {k}) over (partition by user_id order by idx) as b{k}" for k in (1, 2, 3)) + " from {acts}"
    pairs = " union all ".join(f"select {k} as lag_, tok as a, b{k} as b from leads where b{k} is not null" for k in (1, 2, 3))
    return f"with leads as ({leads}) select lag_ as d, n, round(mi, 6) as mi from ({mi(pairs, 'lag_')}) q"


@plan("tk")
def adjacency_distance(d: Spark) -> str:
    """Edit distances of words 1, 2 and 5 apart in a line, and of words at random of the language (gap 0): mean, and shares of 0 and of at most 1."""
    key = f"md5(concat('ad', {KEY}))"
    leads = "select lang, tok, " + ", ".join(f"lead(tok, {k}) over (partition by doc_id, line_no order by pos) as b{k}" for k in (1, 2, 5)) + " from {tk}"
    pairs = " union all ".join(f"select lang, {k} as gap, tok as a, b{k} as b from leads where b{k} is not null" for k in (1, 2, 5))
    shuffled = f"select lang, 0 as gap, tok as a, lead(tok) over (partition by lang, substr(key_, 1, 2) order by key_) as b from (select lang, tok, {key} as key_ from {{tk}}) k"
    return f"with leads as ({leads}) select lang, gap, count(*) as n, round(avg(ed * 1.0e0), 6) as mean_ed, round(avg(case when ed = 0 then 1.0e0 else 0.0e0 end), 6) as p0, round(avg(case when ed <= 1 then 1.0e0 else 0.0e0 end), 6) as p1 from (select lang, gap, case when a = b then 0 else {d.edits('a', 'b')} end as ed from ({pairs} union all select * from ({shuffled}) s where b is not null) u) q group by lang, gap"


@plan("tk", "ty")
def space_gain(d: Spark) -> str:
    """How much better than the base rate the letters on both sides tell where words end; trained on half of the pages."""
    slots = f"""select lang, doc_id % 2 as half, substr(s, cast(i as int), 1) as l, substr(s, cast(i as int) + 1, 1) as r, case when cast(i as int) = m then 1.0e0 else 0.0e0 end as y
        from (select lang, doc_id, concat(tok, left(nxt, 1)) as s, cast(length(tok) as bigint) as m from (select lang, doc_id, tok, lead(tok) over (partition by doc_id, line_no order by pos) as nxt from {{tk}}) q where nxt is not null) z {d.each('1', 'm', 'i')}"""
    return f"""with slots as ({slots}), base as (select lang, avg(y) as p0 from slots where half = 0 group by lang),
        model as (select lang, l, r, sum(y) as k, count(*) as n from slots where half = 0 group by lang, l, r)
        select s.lang, count(*) as slots, round(1 + avg(y * log2(p) + (1 - y) * log2(1 - p)) / -avg(y * log2(p0) + (1 - y) * log2(1 - p0)), 6) as gain,
          round(sum(case when p >= 0.5e0 then y else 0.0e0 end) / nullif(sum(case when p >= 0.5e0 then 1.0e0 else 0.0e0 end), 0.0e0), 6) as precision_, round(sum(case when p >= 0.5e0 then y else 0.0e0 end) / sum(y), 6) as recall_
        from (select t.lang, y, p0, (coalesce(k, 0.0e0) + p0) / (coalesce(n, 0) + 1) as p from slots t join base b on t.lang = b.lang left join model m on t.lang = m.lang and t.l = m.l and t.r = m.r where half = 1) s group by s.lang"""


@plan("lw")
def agreement(d: Spark) -> str:
    """How often neighbours agree in a feature, over what chance gives in their line: sum k (k - 1) / (n (n - 1)) for each of its n - 1 pairs."""
    parts = {"first1": "left({t}, 1)", "first2": "left({t}, 2)", "last1": "right({t}, 1)", "last2": "right({t}, 2)", "whole": "{t}", "length": "cast(length({t}) as string)", "ends": "concat(left({t}, 1), right({t}, 1))"}
    # a line is one row until its words are cut in features: no window, no join
    words = f"select lang, doc_id, line_no, n_line, p_.a as tok, p_.b as nxt from (select lang, doc_id, line_no, {d.size('words')} as n_line, words from {{lw}}) l {d.runs('words', 'pos', 'p_')}"
    features = " union all ".join(f"select lang, '{k}' as feature, doc_id, line_no, n_line, {v.format(t='tok')} as x, case when nxt is not null then {v.format(t='nxt')} end as y from w where n_line >= 2" for k, v in parts.items())
    return f"""with w as ({words}), f as ({features}), c as (select lang, feature, doc_id, line_no, n_line, x, count(*) as k, sum(case when x = y then 1 else 0 end) as hits, count(y) as pairs from f group by lang, feature, doc_id, line_no, n_line, x)
        select lang, feature, cast(sum(pairs) as bigint) as n, round(sum(hits) / nullif(sum(k * (k - 1.0e0) / n_line), 0.0e0), 6) as ratio from c group by lang, feature"""


@plan("tk")
def excess_mi_by_distance(d: Spark) -> str:
    """Boundary information of words 1 to 3 apart beyond words dealt anew over the language, inside pages, and inside lines."""
    rows = "select lang, doc_id, line_no, pos, right(tok, 1) as a, " + ", ".join(f"left(lead(tok, {k}) over (partition by doc_id, line_no order by pos), 1) as b{k}" for k in (1, 2, 3)) + " from {tk}"
    far = lambda k: f"select lang, doc_id, line_no, pos, a, b{k} as b from ({rows}) r0 where b{k} is not null"
    parts = [f"select {k} as d, 'language' as scope, lang, n, mi, chance, excess from ({over_dealt(far(k), 'lang', d)}) x{k}" for k in (1, 2, 3)]
    parts += [f"select {k} as d, '{name}' as scope, lang, n, mi, chance, excess from ({excess(far(k), scope, KEY, d, reps=1)}) x{k}" for k in (1, 2, 3) for name, scope in (("page", "lang, doc_id"), ("line", "lang, doc_id, line_no"))]
    return " union all ".join(parts)
