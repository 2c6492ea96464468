"""Edits marked inside words: where they stand, and how likely the words are that have them (T7a)."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan

#: Share of words that have a mark.
MARKED = 0.01


def _binomial_tails(d: Spark, rows: str, keys: str) -> str:
    """(keys, p_greater, p_here) for rows with n, k and p: the chance of k or more, and of k, as sums that leave out what lies 40 deviations away."""
    low, high = "greatest(k, floor(n * p - 40 * sqrt(n * p * (1 - p)) - 40))", "least(n, greatest(k, ceil(n * p)) + 40 * sqrt(n * p * (1 - p)) + 40)"
    pmf = f"exp({d.ln_factorial('n')} - {d.ln_factorial('j')} - {d.ln_factorial('(n - j)')} + j * ln(p) + (n - j) * ln(1 - p))"
    return f"select {keys}, least(1.0e0, sum(q)) as p_greater, sum(case when j = k then q else 0.0e0 end) as p_here from (select {keys}, k, j, {pmf} as q from (select * from (select *, cast(greatest({low}, 0) as bigint) as low, cast({high} as bigint) as high from ({rows}) r where p > 0 and p < 1) s {d.each('low', 'high', 'j')}) t) u group by {keys}"


@plan("tk", "lw")
def t7a_edits(d: Spark) -> str:
    """Marks that a hash puts in words: their places against those of all letters, with binomial tests, and the median percentile of their words' probability among words of the same length.

    A mark before a word's first letter belongs to the boundary, and tells of the word before it. Probabilities are of a
    letter model of order 2 that backs off, made without the lines that have marks. A percentile comes from counts by
    bits, and inside a step of these from the words themselves: no ranking of all words.
    """
    key = "concat('t7', cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))"
    marks = f"select lang, doc_id, line_no, pos, tok, cast(floor({d.u(key.replace('t7', 't7o'))} * (length(tok) + 1)) as bigint) as off from {{tk}} where {d.u(key)} < {MARKED}e0"
    place = "case when off = 0 and pos > 0 then 'boundary' when off = 0 then 'before' when off = 1 then 'initial' when off = length(tok) then 'final' else 'internal' end"
    events = f"select m.lang, {place} as position, case when off = 0 and pos > 0 then {d.item('words', 'pos')} else tok end as tok from marks m join {{lw}} l on l.doc_id = m.doc_id and l.line_no = m.line_no"
    train = "select t.lang, tok, count(*) as n from {tk} t left join (select distinct doc_id as d_, line_no as l_ from marks) m on m.d_ = t.doc_id and m.l_ = t.line_no where m.d_ is null group by t.lang, tok"
    both = "select lang, tok, sum(n) as n from (select lang, tok, n from train union all select distinct lang, tok, 0 from events) b group by lang, tok"
    grams = f"select lang, tok, n, substr(w, cast(i as int), 2) as c2, substr(w, cast(i as int) + 1, 1) as c1, substr(w, cast(i as int) + 2, 1) as s from (select lang, tok, n, concat('^^', tok, '$') as w, cast(length(tok) + 1 as bigint) as m from both_) q {d.each('1', 'm', 'i')}"
    p0, p1 = "(k0 + 1.0e0) / (n0 + v0)", "(k1 + p0) / (n1 + 1)"
    bits = f"select lang, c2, s, log2((k2 + {p1}) / (n2 + 1)) as b from (select *, {p0} as p0 from cells) c"
    base = "select lang, sum(n) as initial_, sum(case when length(tok) > 1 then n else 0 end) as final_, sum(greatest(0, length(tok) - 2) * n) as internal_ from train group by lang"
    tested = " union all ".join(f"select e.lang, '{k}' as position, sum(case when e.position = '{k}' then 1 else 0 end) as k, count(*) as n, max({k}_ * 1.0e0 / (initial_ + final_ + internal_)) as p from events e join base b on b.lang = e.lang group by e.lang" for k in ("initial", "internal", "final"))
    return f"""with marks as ({marks}), events as ({events}), train as ({train}), both_ as ({both}), grams as ({grams}),
        k2 as (select lang, c2, c1, s, sum(n) * 1.0e0 as k2 from grams group by lang, c2, c1, s), letters as (select lang, s, sum(k2) as k0 from k2 group by lang, s), sizes as (select lang, sum(k0) as n0, count(*) + 1 as v0 from letters where k0 > 0 group by lang),
        cells as (select k.lang, k.c2, k.s, k.k2, sum(k.k2) over (partition by k.lang, k.c2) as n2, sum(k.k2) over (partition by k.lang, k.c1, k.s) as k1, sum(k.k2) over (partition by k.lang, k.c1) as n1, k0, n0, v0 from k2 k join letters l on l.lang = k.lang and l.s = k.s join sizes z on z.lang = k.lang),
        scored as (select g.lang, g.tok, cast(length(g.tok) as bigint) as len, max(g.n) as n, round(sum(b), 9) as lp from grams g join ({bits}) b on b.lang = g.lang and b.c2 = g.c2 and b.s = g.s group by g.lang, g.tok),
        binned as (select *, cast(floor(lp * 16) as bigint) as bin from scored),
        hist as (select lang, len, bin, sum(sum(n)) over (partition by lang, len order by bin) - sum(n) as before, sum(sum(n)) over (partition by lang, len) as total from binned group by lang, len, bin),
        named as (select distinct lang, tok from events),
        ranked as (select x.lang, x.tok, (max(before) + sum(case when y.lp <= x.lp then y.n else 0 end)) * 1.0e0 / nullif(max(total), 0) as pct from (select b.* from binned b join named m on m.lang = b.lang and m.tok = b.tok) x join binned y on y.lang = x.lang and y.len = x.len and y.bin = x.bin join hist h on h.lang = x.lang and h.len = x.len and h.bin = x.bin group by x.lang, x.tok),
        median_ as (select e.lang, count(pct) as scored, {d.percentile('pct', '0.5')} as pct from events e join ranked r on r.lang = e.lang and r.tok = e.tok group by e.lang),
        base as ({base}), tested as ({tested}), tails as ({_binomial_tails(d, 'select * from tested', 'lang, position')})
        select t.lang, t.position, cast(t.n as bigint) as events, cast(t.k as bigint) as k, round(t.k * 1.0e0 / t.n, 6) as share, round(t.p, 6) as base, round(p_greater, 6) as p_greater, round(least(1.0e0, 2 * least(p_greater, 1 - p_greater + p_here)), 6) as p_two_sided, scored, round(pct, 6) as median_percentile
        from tested t join tails on tails.lang = t.lang and tails.position = t.position left join median_ m on m.lang = t.lang"""
