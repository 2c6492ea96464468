"""Whether findings hold when their definitions or pages are changed."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark, poisson
from glyphmill.plans import plan
from glyphmill.sources.corpus import STEPS, integrand

#: Groups that pages are drawn in, whatever their number; draws.
GROUPS, DRAWS = 64, 300


@plan("tk")
def deviant_variants(d: Spark) -> str:
    """Types with a letter pair or triple, ends marked, that no other source, or page, has: how many, and how many of these recur in it."""
    parts = []
    for n in (2, 3):
        for block, name in (("source", "source"), ("cast(doc_id as string)", "page")):
            types = f"select {block} as b, tok, count(*) as n from {{tk}} group by {block}, tok"
            grams = f"select b, tok, n, substr(w, cast(i as int), {n}) as g from (select b, tok, n, concat('^', tok, '$') as w, cast(length(tok) + 3 - {n} as bigint) as m from ({types}) t) q {d.each('1', 'm', 'i')}"
            alone = f"select g from ({grams}) a group by g having min(b) = max(b)"
            parts.append(f"select {n} as size_, '{name}' as block, count(*) as types, round(avg(case when n >= 2 then 1.0e0 else 0.0e0 end), 6) as recurring from (select distinct z.b, z.tok, z.n from ({grams}) z join ({alone}) a on a.g = z.g) y")
    return " union all ".join(parts)


@plan("tk", "lw")
def t2a_difference(d: Spark) -> str:
    """Final forms at line ends inside paragraphs less those at paragraph ends: excess divergence from inner words of the same lengths, with the interval of 300 draws of pages.

    Draws weigh counts by groups of pages, so words are read once. The floor is that of two draws from the pooled letters;
    as inner words are weighed to the lengths of last ones, they count as so many words as would vary as much.
    """
    lines = f"select doc_id, line_no, case when coalesce(lead({d.size('words')}) over (partition by doc_id order by line_no), 0) > 0 then 'margin' else 'para' end as kind from {{lw}}"
    group = f"cast({d.hash32("concat('rt', cast(t.doc_id as string))")} % {GROUPS} as bigint)"
    words = f"select t.lang, {group} as grp, least(length(tok), 8) as len, right(tok, 1) as sym, case when pos < n_line - 1 then 'inner' else kind end as kind from {{tk}} t join ({lines}) l on l.doc_id = t.doc_id and l.line_no = t.line_no where n_line >= 2 and pos > 0"
    return f"with c as (select lang, grp, len, sym, kind, count(*) * 1.0e0 as c from ({words}) w group by lang, grp, len, sym, kind),{t2a_ends(d, 'select distinct lang from {lw}')}"


def t2a_ends(d: Spark, langs: str) -> str:
    """What follows in t2a_difference() from its counts, for the languages of langs."""
    return f"""
        weights as (select lang, grp, rep, case when rep = 0 then 1 else {poisson('u')} end as wt from (select lang, grp, rep, {d.u("concat('rt', lang, cast(grp as string), ':', cast(rep as string))")} as u from (select * from ({langs}) l {d.each('0', str(GROUPS - 1), 'grp')}) g {d.each('0', str(DRAWS), 'rep')}) v),
        drawn as (select c.lang, rep, len, sym, sum(case when kind = 'inner' then wt * c else 0.0e0 end) as inner_, sum(case when kind = 'margin' then wt * c else 0.0e0 end) as margin, sum(case when kind = 'para' then wt * c else 0.0e0 end) as para from c join weights t on t.lang = c.lang and t.grp = c.grp group by c.lang, rep, len, sym),
        kinds as (select lang, rep, 'margin' as kind, len, sym, margin as f, inner_ as i from drawn union all select lang, rep, 'para', len, sym, para, inner_ from drawn),
        sizes as (select lang, rep, kind, len, sum(f) as nf, sum(i) as ni from kinds group by lang, rep, kind, len having sum(f) > 0 and sum(i) > 0),
        n as (select lang, rep, kind, sum(nf) as ni, sum(nf) * sum(nf) / sum(nf * nf / ni) as nj from sizes group by lang, rep, kind),
        cells as (select k.lang, k.rep, k.kind, sym, sum(f) as f, sum(i * nf / s.ni) as i from kinds k join sizes s on s.lang = k.lang and s.rep = k.rep and s.kind = k.kind and s.len = k.len group by k.lang, k.rep, k.kind, sym having sum(f) + sum(i) > 0),
        shares as (select c.lang, c.rep, c.kind, ni, nj, (f + i) / ni / 2 as q, case when f > 0 then f / ni * log2(2 * f / (f + i)) else 0.0e0 end + case when i > 0 then i / ni * log2(2 * i / (f + i)) else 0.0e0 end as seen from cells c join n on n.lang = c.lang and n.rep = c.rep and n.kind = c.kind),
        excess as (select lang, rep, kind, sum(case when s = {STEPS[1]} then seen else 0.0e0 end) / 2 - sum(term) / 2 / ln(2.0e0) as x from ({integrand(d, 'select * from shares')}) y group by lang, rep, kind),
        ends as (select lang, rep, max(case when kind = 'margin' then x end) as margin, max(case when kind = 'para' then x end) as para from excess group by lang, rep)
        select lang, round(max(case when rep = 0 then margin end), 6) as margin, round(max(case when rep = 0 then para end), 6) as para, round(max(case when rep = 0 then margin - para end), 6) as difference,
        round({d.percentile('case when rep > 0 then margin - para end', '0.025')}, 6) as low, round({d.percentile('case when rep > 0 then margin - para end', '0.975')}, 6) as high from ends group by lang"""
