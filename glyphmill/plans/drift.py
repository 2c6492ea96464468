"""Tests of rhythm and change along lines, pages and the corpus, with exact expectations where chance has a formula."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark, poisson
from glyphmill.plans import plan
from glyphmill.plans.information import dealt, mi
from glyphmill.plans.recency import ahead, close


def _lag_profile(unit: str, lags: range) -> str:
    """Agreement of units some words apart in a line over its expectation in lines of three words and more."""
    lines = f"select lang, doc_id, line_no, n, sum(k * (k - 1.0e0)) / (n * (n - 1.0e0)) as p from (select lang, doc_id, line_no, max(n_line) as n, count(*) as k from {{tk}} where n_line >= 3 group by lang, doc_id, line_no, {unit}) q group by lang, doc_id, line_no, n"
    leads = f"select lang, doc_id, line_no, {unit} as x, " + ", ".join(f"lead({unit}, {k}) over (partition by doc_id, line_no order by pos) as x{k}" for k in lags) + " from {tk} where n_line >= 3"
    seen = " union all ".join(f"select lang, {k} as k, sum(case when x = x{k} then 1.0e0 else 0.0e0 end) as hits from leads group by lang" for k in lags)
    chance = " union all ".join(f"select lang, {k} as k, sum(greatest(n - {k}, 0) * p) as e from chance_lines group by lang" for k in lags)
    return f"with leads as ({leads}), chance_lines as ({lines}), prof as (select s.lang, s.k, s.hits / nullif(e.e, 0.0e0) as ratio from ({seen}) s join ({chance}) e on s.lang = e.lang and s.k = e.k) "


@plan("tk")
def t4a_lag_profile(d: Spark) -> str:
    """Last letters 2 to 8 words apart: agreement over chance, and which lags are peaks."""
    return _lag_profile("right(tok, 1)", range(2, 9)) + "select lang, k, round(ratio, 6) as ratio, case when lag(ratio) over (partition by lang order by k) < ratio and lead(ratio) over (partition by lang order by k) < ratio then true else false end as peak from prof"


@plan("tk")
def t4a_errors(d: Spark) -> str:
    """The same ratios with their errors: pages drawn 200 times, as often as a Poisson number of mean 1 from a hash says."""
    lags = range(2, 9)
    lines = "select lang, doc_id, n, sum(k * (k - 1.0e0)) / (n * (n - 1.0e0)) as p from (select lang, doc_id, line_no, max(n_line) as n, count(*) as k from {tk} where n_line >= 3 group by lang, doc_id, line_no, right(tok, 1)) q group by lang, doc_id, line_no, n"
    leads = "select lang, doc_id, right(tok, 1) as x, " + ", ".join(f"lead(right(tok, 1), {k}) over (partition by doc_id, line_no order by pos) as x{k}" for k in lags) + " from {tk} where n_line >= 3"
    hits = "select lang, doc_id, " + ", ".join(f"sum(case when x = x{k} then 1.0e0 else 0.0e0 end) as h{k}" for k in lags) + f" from ({leads}) l group by lang, doc_id"
    chance = "select doc_id, " + ", ".join(f"sum(greatest(n - {k}, 0) * p) as e{k}" for k in lags) + f" from ({lines}) c group by doc_id"
    u = d.u("concat('t4', cast(rep as string), ':', cast(doc_id as string))")
    drawn = f"select *, case when rep = 0 then 1 else {poisson('u')} end as w from (select p.*, rep, {u} as u from p {d.each('0', '200', 'rep')}) x"
    sums = "select lang, rep, " + ", ".join(f"sum(w * h{k}) / nullif(sum(w * e{k}), 0.0e0) as r{k}" for k in lags) + f" from ({drawn}) y group by lang, rep"
    rows = " union all ".join(f"select lang, {k} as k, rep, r{k} as r from s" for k in lags)
    return f"""with p as (select h.*, {", ".join(f"e{k}" for k in lags)} from ({hits}) h join ({chance}) e on e.doc_id = h.doc_id), s as ({sums})
        select lang, k, round(max(case when rep = 0 then r end), 6) as ratio, round(stddev_samp(case when rep > 0 then r end), 6) as se from ({rows}) z group by lang, k"""


@plan("tk")
def t4a_initial(d: Spark) -> str:
    return _lag_profile("left(tok, 1)", range(2, 9)) + "select lang, k, round(ratio, 6) as ratio from prof"


@plan("tk")
def t4b_columns(d: Spark) -> str:
    """Inner words of lines 1 to 3 apart: agreement in first and last letter in the same place, over places beside it."""
    inner = "select lang, doc_id, line_no, pos, concat(left(tok, 1), right(tok, 1)) as u from {tk} where pos > 0 and pos < n_line - 1"
    moved = f"select lang, doc_id, line_no + k as to_line, pos + off as to_pos, k, off, u from (select * from ({inner}) i {d.each('1', '3', 'k')}) a {d.each('(-2)', '2', 'off')}"
    return f"""select lang, k, round(avg(case when off = 0 then hit end), 6) as aligned, round(avg(case when off <> 0 then hit end), 6) as beside, round(avg(case when off = 0 then hit end) / nullif(avg(case when off <> 0 then hit end), 0.0e0), 6) as ratio
        from (select x.lang, x.k, x.off, case when x.u = y.u then 1.0e0 else 0.0e0 end as hit from ({moved}) x join ({inner}) y on x.doc_id = y.doc_id and y.line_no = x.to_line and y.pos = x.to_pos) q group by lang, k"""


@plan("tk")
def t4c_line_cycle(d: Spark) -> str:
    """Cosine of lines as counts of letter pairs at word edges, up to 12 lines apart, over the page's mean: half the square of the sum of its lines' unit vectors, less their own."""
    lines = "select lang, doc_id, line_no, u, c / sqrt(q) as x from (select lang, doc_id, line_no, concat(left(tok, 1), right(tok, 1)) as u, count(*) * 1.0e0 as c, sum(count(*) * count(*)) over (partition by doc_id, line_no) * 1.0e0 as q from {tk} group by lang, doc_id, line_no, concat(left(tok, 1), right(tok, 1))) z"
    return f"""with v as ({lines}), n as (select doc_id, count(*) * 1.0e0 as m from (select distinct doc_id, line_no from {{tk}}) z group by doc_id),
        means as (select s.doc_id, (sum(t * t) - max(m)) / (max(m) * (max(m) - 1.0e0)) as mean_ from (select doc_id, u, sum(x) as t from v group by doc_id, u) s join n on n.doc_id = s.doc_id where m > 1 group by s.doc_id),
        pairs as (select a.lang, a.doc_id, a.line_no, a.k, sum(a.x * b.x) as cos from (select * from v {d.each('1', '12', 'k')}) a join v b on b.doc_id = a.doc_id and b.u = a.u and b.line_no = a.line_no + a.k group by a.lang, a.doc_id, a.line_no, a.k)
        select p.lang, p.k, round(sum(cos) / sum(mean_), 6) as ratio, count(*) as n from pairs p join means on means.doc_id = p.doc_id group by p.lang, p.k"""


def _recency(d: Spark, near: bool) -> str:
    """Repeats at distances 2 to 40 in pages of ten words and more over exact expectations."""
    page = "select doc_id, lang, tok, count(*) as k, sum(count(*)) over (partition by doc_id) as n from {tp} group by doc_id, lang, tok"
    if near:
        hits = close(d, "{tp}", "y.tok = e.b", extra="join {ed1} e on e.a = x.tok")
        chance = f"select x.doc_id, x.lang, max(x.n) as n, sum(x.k * y.k * 1.0e0) / (max(x.n) * (max(x.n) - 1.0e0)) as p from ({page}) x join {{ed1}} e on x.tok = e.a join ({page}) y on x.doc_id = y.doc_id and y.tok = e.b group by x.doc_id, x.lang"
    else:
        hits = close(d, "{tp}")
        chance = f"select doc_id, lang, max(n) as n, sum(k * (k - 1.0e0)) / (max(n) * (max(n) - 1.0e0)) as p from ({page}) q group by doc_id, lang"
    return f"with seen as (select lang, dist, count(*) * 1.0e0 as hits from ({hits}) h join (select doc_id as d_, count(*) as m from {{tp}} group by doc_id) s on h.doc_id = s.d_ where m >= 10 group by lang, dist), chance_pages as ({chance}), "


def _recency_ratio(d: Spark) -> str:
    return f"ratios as (select e.lang, e.dist, coalesce(s.hits, 0.0e0) / nullif(e.e, 0.0e0) as ratio from (select lang, dist, sum(greatest(n - dist, 0) * p) as e from (select lang, n, p, dist from chance_pages {d.each('2', '40', 'dist')}) z where n >= 10 group by lang, dist) e left join seen s on s.lang = e.lang and s.dist = e.dist) "


@plan("tp")
def t6a_recency(d: Spark) -> str:
    """Exact repeats by distance, over chance."""
    return _recency(d, False) + _recency_ratio(d) + "select lang, dist, round(ratio, 6) as ratio from ratios"


@plan("tp")
def t6a_decay(d: Spark) -> str:
    """Mean ratio of near distances (2-5) less that of far ones (21-40)."""
    return _recency(d, False) + _recency_ratio(d) + "select lang, round(avg(case when dist <= 5 then ratio end) - avg(case when dist >= 21 then ratio end), 6) as decay from ratios group by lang"


@plan("tp", "ed1")
def t6a_near(d: Spark) -> str:
    """The same for words one edit apart."""
    return _recency(d, True) + _recency_ratio(d) + "select lang, round(avg(case when dist <= 5 then ratio end) - avg(case when dist >= 21 then ratio end), 6) as decay, round(avg(ratio), 6) as mean_ratio from ratios group by lang"


@plan("acts")
def event_recency(d: Spark) -> str:
    """Repeats of event types by distance in a user's events, over chance."""
    block = "cast(floor(idx / 20.0e0) as bigint)"
    page = "select user_id, tok, count(*) as k, sum(count(*)) over (partition by user_id) as n from {acts} group by user_id, tok"
    return f"""select cast(s.dist as bigint) as dist, round(s.hits / e.e, 6) as ratio from (select y.idx - x.idx as dist, count(*) * 1.0e0 as hits from (select * from (select *, {block} as block from {{acts}}) b {d.each('block', 'block + 1', 'near')}) x join (select *, {block} as block from {{acts}}) y on x.user_id = y.user_id and x.tok = y.tok and y.block = x.near and y.idx between x.idx + 1 and x.idx + 20 group by y.idx - x.idx) s
        join (select dist, sum(greatest(n - dist, 0) * p) as e from (select n, p, dist from (select user_id, max(n) as n, sum(k * (k - 1.0e0)) / (max(n) * (max(n) - 1.0e0)) as p from ({page}) q where n > 1 group by user_id) w {d.each('1', '20', 'dist')}) z group by dist) e on s.dist = e.dist"""


@plan("tk")
def t3a_zero_replication(d: Spark) -> str:
    """Letter pairs that half of a language's lines lack though chance gives three or more: how far the other half lacks them too."""
    marked = f"select lang, line_no % 2 as half, substr(t, cast(i as int), 1) as a, substr(t, cast(i as int) + 1, 1) as b from (select lang, line_no, concat('^', tok, '$') as t, cast(length(tok) as bigint) + 1 as m from {{tk}}) q {d.each('1', 'm', 'i')}"
    return f"""with g as (select lang, half, a, b, count(*) * 1.0e0 as c from ({marked}) z group by lang, half, a, b), r as (select lang, half, a, sum(c) as ra from g group by lang, half, a), s as (select lang, half, b, sum(c) as sb from g group by lang, half, b), n as (select lang, half, sum(c) as n from g group by lang, half),
        e as (select r.lang, r.half, r.a, s.b, ra * sb / n as e from r join s on r.lang = s.lang and r.half = s.half join n on n.lang = r.lang and n.half = r.half)
        select x.lang, count(*) as cells, round(sum(coalesce(o.c, 0.0e0)) / sum(y.e), 6) as rho from e x join e y on x.lang = y.lang and x.half <> y.half and x.a = y.a and x.b = y.b
        left join g z on z.lang = x.lang and z.half = x.half and z.a = x.a and z.b = x.b left join g o on o.lang = y.lang and o.half = y.half and o.a = y.a and o.b = y.b
        where z.c is null and x.e >= 3 and not (x.a = '^' and x.b = '$') group by x.lang"""


@plan("tk")
def t2a_final_form(d: Spark) -> str:
    """Divergence of last letters of words at line ends from those of inner words, which are weighted to the same lengths. What labels dealt anew give: t2a_permutations."""
    rows = "select lang, least(length(tok), 8) as len, length(tok) as size_, right(tok, 1) as sym, case when pos = n_line - 1 then 1 else 0 end as fin from {tk} where n_line >= 2 and pos > 0"
    return f"""with r as ({rows}), c as (select lang, len, sym, fin, count(*) * 1.0e0 as c from r group by lang, len, sym, fin), t as (select lang, len, sum(case when fin = 1 then c else 0.0e0 end) as nf, sum(case when fin = 0 then c else 0.0e0 end) as ni from c group by lang, len),
        w as (select c.lang, c.sym, sum(case when fin = 1 then c else 0.0e0 end) as f, sum(case when fin = 0 then c * nf / ni else 0.0e0 end) as i from c join t on c.lang = t.lang and c.len = t.len where nf > 0 and ni > 0 group by c.lang, c.sym),
        p as (select lang, sym, f / sum(f) over (partition by lang) as f, i / sum(i) over (partition by lang) as i from w),
        j as (select lang, sum(case when f > 0 then f * log2(2 * f / (f + i)) else 0.0e0 end + case when i > 0 then i * log2(2 * i / (f + i)) else 0.0e0 end) / 2 as jsd from p group by lang),
        z as (select lang, cast(sum(fin) as bigint) as n_final, avg(case when fin = 1 then size_ * 1.0e0 end) as lf, avg(case when fin = 0 then size_ * 1.0e0 end) as li from r group by lang)
        select j.lang, n_final, round(jsd, 6) as jsd, round(lf, 6) as length_final, round(li, 6) as length_inner from j join z on j.lang = z.lang"""


@plan("lw")
def t2c_dittography(d: Spark) -> str:
    """Last words of lines that come again as the next line's first, one word and two, and what lines in any order of their page give, exactly."""
    w = lambda k: d.item("words", k)
    two = lambda a, b: f"case when {d.size('words')} >= 2 then concat({w(a)}, ' ', {w(b)}) end"
    lines = f"select lang, doc_id, line_no, {w('-1')} as l, {w('1')} as f, {two('-2', '-1')} as l2, {two('1', '2')} as f2 from {{lw}} where {d.size('words')} >= 1"

    def same(last: str, first: str) -> str:
        """Per page: of all ordered pairs of different lines, those that fit."""
        return f"""select lang, doc_id, sum(c) as c from (select x.lang, x.doc_id, x.k * y.k as c from (select lang, doc_id, {last} as w, count(*) as k from l where {last} is not null group by lang, doc_id, {last}) x join (select doc_id, {first} as w, count(*) as k from l where {first} is not null group by doc_id, {first}) y on x.doc_id = y.doc_id and x.w = y.w
            union all select lang, doc_id, -count(*) from l where {last} = {first} group by lang, doc_id) s group by lang, doc_id"""

    return f"""with l as ({lines}), m as (select lang, doc_id, count(*) as m, count(l2) as q from l group by lang, doc_id),
        o as (select lang, count(nf) as n, sum(case when l = nf then 1.0e0 else 0.0e0 end) as e, sum(case when l2 is not null and nf2 is not null then 1.0e0 else 0.0e0 end) as n2, sum(case when l2 = nf2 then 1.0e0 else 0.0e0 end) as e2 from (select lang, l, l2, lead(f) over (partition by doc_id order by line_no) as nf, lead(f2) over (partition by doc_id order by line_no) as nf2 from l) x group by lang),
        c as (select m.lang, sum(coalesce(a.c, 0) * 1.0e0 / m.m) as e, sum(coalesce(b.c, 0) * 1.0e0 / m.m) as e2, sum(q * (q - 1.0e0) / m.m) as n2 from m left join ({same('l', 'f')}) a on a.doc_id = m.doc_id left join ({same('l2', 'f2')}) b on b.doc_id = m.doc_id group by m.lang)
        select o.lang, o.n, round(o.e / o.n, 6) as rate, round(c.e / o.n, 6) as chance, round(o.e / nullif(c.e, 0.0e0), 6) as ratio, round((o.e - c.e) / sqrt(nullif(c.e, 0.0e0)), 6) as z, round(o.e2 / nullif(o.n2, 0.0e0), 6) as rate2, round(c.e2 / nullif(c.n2, 0.0e0), 6) as chance2 from o join c on o.lang = c.lang"""


@plan("tk")
def t1_line_break(d: Spark) -> str:
    """Boundary information across line breaks over that inside lines, both less what any re-pairing inside the page or block gives on average; pages weighted by their breaks."""
    ends = "select lang, doc_id, line_no, max_by(tok, pos) as last, min_by(tok, pos) as first from {tk} where n_line >= 2 group by lang, doc_id, line_no"
    across = f"select lang, doc_id, 'break' as kind, line_no as k1, 0 as k2, right(last, 1) as a, left(nxt, 1) as b from (select *, lead(first) over (partition by doc_id order by line_no) as nxt from ({ends}) e) x where nxt is not null"
    inner = "select lang, doc_id, 'inner' as kind, line_no as k1, pos + 1 as k2, right(tok, 1) as a, left(nxt, 1) as b from (select *, lead(tok) over (partition by doc_id, line_no order by pos) as nxt from {tk} where n_line >= 2) y where nxt is not null"
    breaks = f"select doc_id as page_, count(*) as k from ({across}) a group by doc_id having count(*) >= 2"
    blocks = f"select * from (select p.*, case when kind = 'break' then 0 else cast(floor((row_number() over (partition by doc_id, kind order by k1, k2) - 1) / k) as bigint) end as block, k from ({across} union all {inner}) p join ({breaks}) c on doc_id = page_) q"
    full = f"select lang, doc_id, kind, block, k, a, b from (select z.*, count(*) over (partition by doc_id, kind, block) as m from ({blocks}) z) y where m = k"
    by = "lang, doc_id, kind, block, k"
    return f"""with f as ({full}), e as (select o.lang, o.doc_id, o.kind, o.k, o.mi - c.mi as x from ({mi('select * from f', by)}) o join ({dealt('select * from f', by, d)}) c on o.doc_id = c.doc_id and o.kind = c.kind and o.block = c.block),
        p as (select lang, doc_id, kind, max(k) as k, avg(x) as x from e group by lang, doc_id, kind), g as (select lang, doc_id, max(k) as k, max(case when kind = 'break' then x end) as b, max(case when kind = 'inner' then x end) as i from p group by lang, doc_id)
        select lang, round(sum(b * k) / sum(k), 6) as break_, round(sum(i * k) / sum(k), 6) as inner_, count(*) as pages from g where b is not null and i is not null group by lang"""


@plan("tk")
def t7b_deviant(d: Spark) -> str:
    """Words with a letter triple that no other source has: per thousand words, and how many recur in their source."""
    types = f"select source, tok, count(*) as n from {{tk}} where length(tok) >= 3 group by source, tok"
    grams = f"select source, tok, n, substr(tok, cast(i as int), 3) as g from (select source, tok, n, cast(length(tok) as bigint) - 2 as m from ({types}) t) q {d.each('1', 'm', 'i')}"
    alone = f"select g from ({grams}) z group by g having count(distinct source) = 1"
    return f"select t.source, count(distinct t.tok) as types, cast(sum(t.n) as bigint) as tokens, round(1000.0e0 * sum(t.n) / max(total), 6) as per_thousand, round(avg(case when t.n >= 2 then 1.0e0 else 0.0e0 end), 6) as recurring from (select distinct z.source, z.tok, z.n from ({grams}) z join ({alone}) a on z.g = a.g) t join (select source, count(*) as total from {{tk}} group by source) s on t.source = s.source group by t.source"


@plan("tp")
def recurrence_gaps(d: Spark) -> str:
    """Median gap between a word's occurrences in its page by how often it is met there."""
    gap = "idx - lag(idx) over (partition by doc_id, tok order by idx)"
    return f"select lang, least(k, 6) as k, count(*) as n, round({d.percentile('gap * 1.0e0', '0.5')}, 6) as median_gap from (select lang, {gap} as gap, count(*) over (partition by doc_id, tok) as k from {{tp}}) q where gap is not null group by lang, least(k, 6)"


@plan("tk")
def e5_burstiness(d: Spark) -> str:
    """Pairs of a word in one page over what its spread over a language's and source's pages gives, by frequency band."""
    return """with p as (select lang, source, doc_id, tok, count(*) as k from {tk} group by lang, source, doc_id, tok), g as (select lang, source, tok, sum(k) as n from p group by lang, source, tok), m as (select lang, source, doc_id, sum(k) as np from p group by lang, source, doc_id),
        f as (select lang, source, sum(np * (np - 1.0e0)) / (max(t) * (max(t) - 1.0e0)) as f from (select *, sum(np) over (partition by lang, source) as t from m) q group by lang, source), total as (select tok, sum(n) as n from g group by tok),
        o as (select tok, sum(k * (k - 1.0e0)) / 2 as o from p group by tok), e as (select g.tok, sum(g.n * (g.n - 1.0e0) / 2 * f.f) as e from g join f on g.lang = f.lang and g.source = f.source group by g.tok)
        select case when n < 2 then 'H' when n < 5 then 'R' when n < 20 then 'M' when n < 100 then 'F' else 'VF' end as band, round(sum(o.o) / nullif(sum(e.e), 0.0e0), 6) as b from total t join o on o.tok = t.tok join e on e.tok = t.tok where t.n >= 2 group by 1"""


@plan("tk")
def e5_gap(d: Spark) -> str:
    """How much burstier rare words are than frequent ones, ln B of band R less ln B of band F, with the error of leaving out one source after another."""
    return """with p as (select lang, source, doc_id, tok, count(*) as k from {tk} group by lang, source, doc_id, tok), g as (select lang, source, tok, sum(k) as n, sum(k * (k - 1.0e0)) / 2 as o from p group by lang, source, tok), m as (select lang, source, doc_id, sum(k) as np from p group by lang, source, doc_id),
        f as (select lang, source, sum(np * (np - 1.0e0)) / nullif(max(t) * (max(t) - 1.0e0), 0.0e0) as f from (select *, sum(np) over (partition by lang, source) as t from m) q group by lang, source), total as (select tok, sum(n) as n from g group by tok having sum(n) >= 2 and sum(n) < 100),
        b as (select g.source, sum(case when t.n < 5 then g.o end) as orare, sum(case when t.n < 5 then g.n * (g.n - 1.0e0) / 2 * f.f end) as erare, sum(case when t.n >= 20 then g.o end) as ofreq, sum(case when t.n >= 20 then g.n * (g.n - 1.0e0) / 2 * f.f end) as efreq from g join f on g.lang = f.lang and g.source = f.source join total t on t.tok = g.tok group by g.source),
        s as (select sum(orare) as orare, sum(erare) as erare, sum(ofreq) as ofreq, sum(efreq) as efreq, count(*) as k from b),
        l as (select ln((s.orare - coalesce(b.orare, 0.0e0)) / (s.erare - coalesce(b.erare, 0.0e0))) - ln((s.ofreq - coalesce(b.ofreq, 0.0e0)) / (s.efreq - coalesce(b.efreq, 0.0e0))) as v, ln(s.orare / s.erare) - ln(s.ofreq / s.efreq) as full_, s.k from b join s on s.k > 1)
        select count(*) as groups, round(max(full_), 6) as gap, round(sqrt((max(k) - 1.0e0) / max(k) * sum((v - mean_) * (v - mean_))), 6) as se from (select *, avg(v) over (partition by k) as mean_ from l) q"""


@plan("tk")
def e4_line_drift(d: Spark) -> str:
    """Cosine of lines as word counts by their distance, over the page's mean, and its slope over 2 to 8 lines."""
    lines = "select lang, doc_id, line_no, tok, count(*) * 1.0e0 as c, sum(count(*) * count(*)) over (partition by doc_id, line_no) as q from {tk} group by lang, doc_id, line_no, tok"
    pairs = f"select x.lang, x.doc_id, x.k, sum(x.c * y.c) / sqrt(max(x.q) * 1.0e0 * max(y.q)) as cos from (select * from ({lines}) l {d.each('2', '8', 'k')}) x join ({lines}) y on x.doc_id = y.doc_id and y.line_no = x.line_no + x.k and x.tok = y.tok group by x.lang, x.doc_id, x.line_no, x.k"
    return f"select lang, round(regr_slope(cos, k), 6) as slope, round(regr_intercept(cos, k), 6) as intercept, count(*) as n from (select lang, k, avg(cos) as cos from ({pairs}) p group by lang, k) q group by lang"


@plan("tp")
def e1_boundary_recency(d: Spark) -> str:
    """Repeats 2 to 40 words apart by whether they share the line, over what words dealt anew inside their classes of places would give.

    A class is a word's distance from the ends of its line, up to two; a pair's expectation is the share of equal words
    among pairs of its two classes on the page.
    """
    place = "concat(cast(least(pos, 2) as string), cast(least(n_line - 1 - pos, 2) as string))"
    words = f"select lang, doc_id, line_no, idx, tok, {place} as cls from {{tp}}"
    return f"""with w as ({words}), k as (select doc_id, cls, tok, count(*) * 1.0e0 as k from w group by doc_id, cls, tok), n as (select doc_id, cls, sum(k) as n from k group by doc_id, cls),
        s as (select x.doc_id, x.cls as cx, y.cls as cy, sum(x.k * (y.k - case when x.cls = y.cls then 1 else 0 end)) as same from k x join k y on x.doc_id = y.doc_id and x.tok = y.tok group by x.doc_id, x.cls, y.cls),
        e as (select a.doc_id, a.cls as cx, b.cls as cy, coalesce(s.same, 0.0e0) / nullif(a.n * (b.n - case when a.cls = b.cls then 1 else 0 end), 0.0e0) as p from n a join n b on a.doc_id = b.doc_id left join s on s.doc_id = a.doc_id and s.cx = a.cls and s.cy = b.cls),
        o as (select lang, doc_id, case when line_x = line_y then 'same_line' else 'cross_line' end as kind, cx, cy, count(*) as pairs from (select lang, doc_id, substr(x, 1, 2) as cx, substr(y, 1, 2) as cy, substr(x, 3) as line_x, substr(y, 3) as line_y from ({ahead(d, 'w', "concat(cls, cast(line_no as string))", 'lang, doc_id')}) a) b group by lang, doc_id, case when line_x = line_y then 'same_line' else 'cross_line' end, cx, cy),
        h as (select doc_id, kind, cx, cy, count(*) * 1.0e0 as hits from ({close(d, 'w', columns="x.doc_id, case when x.line_no = y.line_no then 'same_line' else 'cross_line' end as kind, x.cls as cx, y.cls as cy")}) c group by doc_id, kind, cx, cy),
        q as (select o.*, coalesce(hits, 0.0e0) as hits from o left join h on h.doc_id = o.doc_id and h.kind = o.kind and h.cx = o.cx and h.cy = o.cy)
        select q.lang, q.kind, cast(sum(q.pairs) as bigint) as pairs, round(sum(q.hits) / nullif(sum(q.pairs * e.p), 0.0e0), 6) as ratio from q join e on q.doc_id = e.doc_id and q.cx = e.cx and q.cy = e.cy group by q.lang, q.kind"""


@plan("tk")
def window_percentiles(d: Spark) -> str:
    """Where each source's share of one-letter words lies among fifty windows of as many words from anywhere in its language."""
    words = "select lang, source, case when length(tok) = 1 then 1.0e0 else 0.0e0 end as y, row_number() over (partition by lang order by doc_id, line_no, pos) as r, count(*) over (partition by lang) as n from {tk}"
    own = "select lang, source, avg(y) as v, count(*) as size from w group by lang, source"
    starts = f"select lang, source, v, size, k, cast(floor({d.u("concat('w', lang, source, cast(k as string))")} * (n - size)) as bigint) as s from (select o.lang, o.source, v, size, n from ({own}) o join (select lang, max(n) as n from w group by lang) m on o.lang = m.lang) z {d.each('1', '50', 'k')}"
    return f"""with w as ({words}), c as (select lang, r, sum(y) over (partition by lang order by r rows between unbounded preceding and current row) as upto from w)
        select t.lang, t.source, round(max(t.v), 6) as share, round(avg(case when (b.upto - coalesce(a.upto, 0.0e0)) / t.size < t.v - 1e-12 then 1.0e0 else 0.0e0 end), 6) as percentile_ from ({starts}) t join c b on b.lang = t.lang and b.r = t.s + t.size left join c a on a.lang = t.lang and a.r = t.s group by t.lang, t.source"""


@plan("tk")
def positive_control(d: Spark) -> str:
    """A divergence that is put in on purpose: a tenth of even pages' words is replaced by a mark, and a test of halves finds it."""
    key = "concat('pc', cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))"
    marked = f"select lang, doc_id % 2 as half, left(case when doc_id % 2 = 0 and {d.u(key)} < 0.1e0 then '#' else tok end, 1) as sym, left(tok, 1) as plain from {{tk}}"
    parts = []
    for column in ("sym", "plain"):
        shares = f"select lang, {column} as s, sum(case when half = 0 then 1.0e0 else 0.0e0 end) as a, sum(case when half = 1 then 1.0e0 else 0.0e0 end) as b from m group by lang, {column}"
        both = f"select lang, s, a / sum(a) over (partition by lang) as p, b / sum(b) over (partition by lang) as q from ({shares}) x"
        parts.append(f"select lang, '{column}' as kind, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0.0e0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0.0e0 end) / 2 as jsd from ({both}) y group by lang")
    return f"with m as ({marked}) select lang, round(max(case when kind = 'sym' then jsd end), 6) as injected, round(max(case when kind = 'plain' then jsd end), 6) as plain from ({' union all '.join(parts)}) z group by lang"


@plan("ch", "tk")
def token_chunks(d: Spark) -> str:
    """Chunks of 250 words and more that a language's lines fill one after another, across pages, and the words in them."""
    return "select c.lang, count(distinct chunk) as chunks, count(*) as words, min(n) as least_, max(n) as most_ from (select c.lang, chunk, count(*) over (partition by c.lang, chunk) as n from {ch} c join {tk} t on t.lang = c.lang and t.doc_id = c.doc_id and t.line_no = c.line_no) c group by c.lang"


@plan("ch", "tk")
def t3a_chunks(d: Spark) -> str:
    """Letter pairs that half of a chunk's lines lack though chance gives three or more: how far the other half lacks them too, over all chunks, with the interval of 1,000 draws of chunks."""
    words = "select c.lang, c.chunk, c.nth % 2 as half, concat('^', t.tok, '$') as t, cast(length(t.tok) as bigint) + 1 as m, count(*) as n from {ch} c join {tk} t on t.lang = c.lang and t.doc_id = c.doc_id and t.line_no = c.line_no group by c.lang, c.chunk, c.nth % 2, t.tok"
    by = "lang, chunk, half"
    on = lambda x, y, *more: " and ".join(f"{x}.{c} = {y}.{c}" for c in ("lang", "chunk", *more))
    return f"""with g as (select {by}, substr(t, cast(i as int), 1) as a, substr(t, cast(i as int) + 1, 1) as b, sum(n) * 1.0e0 as c from (select * from ({words}) w {d.each('1', 'm', 'i')}) z group by {by}, substr(t, cast(i as int), 1), substr(t, cast(i as int) + 1, 1)),
        r as (select {by}, a, sum(c) as ra from g group by {by}, a), s as (select {by}, b, sum(c) as sb from g group by {by}, b), n as (select {by}, sum(c) as n from g group by {by}),
        x as (select r.lang, r.chunk, r.half, r.a, s.b from r join s on {on('r', 's', 'half')} join n on {on('n', 'r', 'half')} left join g on {on('g', 'r', 'half', 'a')} and g.b = s.b where g.c is null and ra * sb / n >= 3 and not (r.a = '^' and s.b = '$')),
        k as (select x.lang, x.chunk, count(*) as cells, sum(coalesce(o.c, 0.0e0)) as obs, sum(coalesce(r.ra * s.sb / n.n, 0.0e0)) as exp_ from x left join g o on {on('o', 'x', 'a', 'b')} and o.half <> x.half left join r on {on('r', 'x', 'a')} and r.half <> x.half left join s on {on('s', 'x', 'b')} and s.half <> x.half left join n on {on('n', 'x')} and n.half <> x.half group by x.lang, x.chunk),
        every as (select c.lang, c.chunk, coalesce(cells, 0) as cells, coalesce(obs, 0.0e0) as obs, coalesce(exp_, 0.0e0) as exp_ from (select distinct lang, chunk from {{ch}}) c left join k on {on('k', 'c')}),
        drawn as (select lang, rep, sum(w * obs) / nullif(sum(w * exp_), 0.0e0) as rho from (select lang, rep, obs, exp_, {poisson('u')} as w from (select e.*, rep, {d.u("concat('t3', lang, cast(chunk as string), ':', cast(rep as string))")} as u from every e {d.each('1', '1000', 'rep')}) v where exp_ > 0) w group by lang, rep),
        ends as (select lang, {d.percentile('rho', '0.025')} as low, {d.percentile('rho', '0.975')} as high from drawn group by lang)
        select e.lang, count(*) as chunks, cast(sum(cells) as bigint) as cells, round(sum(obs), 6) as obs, round(sum(exp_), 6) as expected, round(sum(obs) / nullif(sum(exp_), 0.0e0), 6) as rho, round(max(low), 6) as low, round(max(high), 6) as high from every e left join ends on ends.lang = e.lang group by e.lang"""


@plan("xs")
def t5_excess_matrix(d: Spark) -> str:
    """Excess divergence of every two pages of a run."""
    return "select lang, run, i, j, round(x, 6) as excess from {xs}"


#: Runs of fewer pages have no shape.
RUN_PAGES = 10


def _smooth() -> str:
    """Runs, and each run without one page in turn: the line of excess over distance, and how it tells that page's pairs. (lang, run, page, n, a, b, e); page null: the whole run."""
    sums = "count(*) * 1.0e0 as n, sum(r) as sr, sum(r * r) as srr, sum(x) as sx, sum(x * r) as sxr, sum(x * x) as sxx"
    line = "select *, (n * sxr - sr * sx) / (n * srr - sr * sr) as b, (sx - (n * sxr - sr * sx) / (n * srr - sr * sr) * sr) / n as a"
    return f"""xr as (select lang, run, i, j, x, (j - i) * 1.0e0 as r from {{xs}}), big as (select lang, run, max(j) + 1 as pages from {{xs}} group by lang, run having max(j) + 1 >= {RUN_PAGES}),
        whole as (select xr.lang, xr.run, {sums}, max(pages) as pages from xr join big on big.lang = xr.lang and big.run = xr.run group by xr.lang, xr.run),
        page_ as (select lang, run, page, {sums} from (select lang, run, i as page, x, r from xr union all select lang, run, j, x, r from xr) u group by lang, run, page),
        rest as (select p.lang, p.run, p.page, p.n as pn, p.sr as psr, p.srr as psrr, p.sx as psx, p.sxr as psxr, p.sxx as psxx, w.n - p.n as n, w.sr - p.sr as sr, w.srr - p.srr as srr, w.sx - p.sx as sx, w.sxr - p.sxr as sxr from page_ p join whole w on w.lang = p.lang and w.run = p.run),
        told as (select lang, run, sum(pn * a * a + b * b * psrr + psxx + 2 * a * b * psr - 2 * a * psx - 2 * b * psxr) as line_error from ({line} from rest) z group by lang, run),
        fitted as ({line} from whole)"""


@plan("xs", "pg")
def t5_consecutive(d: Spark) -> str:
    """How change is spread over the steps between consecutive pages of a run: mean, Gini, and how many of the largest tenth are where the source changes; and how a line over distance tells the pairs of a page that is left out."""
    step = "select x.lang, x.run, x.i, x.x, case when a.source <> b.source then 1.0e0 else 0.0e0 end as edge from {xs} x join {pg} a on a.lang = x.lang and a.run = x.run and a.place = x.i join {pg} b on b.lang = x.lang and b.run = x.run and b.place = x.j where x.j = x.i + 1"
    ranked = f"select *, row_number() over (partition by lang, run order by round(greatest(x, 0.0e0), 9), i) as up, row_number() over (partition by lang, run order by round(x, 9) desc, i) as down, count(*) over (partition by lang, run) as n from ({step}) s"
    return f"""with {_smooth()}, g as (select lang, run, avg(x) as mean_, coalesce(sum((2 * up - n - 1) * greatest(x, 0.0e0)) / nullif(max(n) * sum(greatest(x, 0.0e0)), 0.0e0), 0.0e0) as gini, avg(case when down <= greatest(1, floor(n / 10.0e0)) then edge end) as top_edge, avg(edge) as edge from ({ranked}) r group by lang, run)
        select f.lang, f.run, f.pages, round(mean_, 6) as mean_excess, round(gini, 6) as gini, round(top_edge, 6) as top_on_boundary, round(edge, 6) as boundaries, round(a, 6) as intercept, round(b, 6) as slope, round(line_error, 6) as line_error
        from fitted f join told t on t.lang = f.lang and t.run = f.run join g on g.lang = f.lang and g.run = f.run"""


@plan("xs")
def t5_step_and_slope(d: Spark) -> str:
    """Excess divergence of a run's pages by their distance, and by the side of the cut that tells it best: slope and step with their mean square errors, over a language's runs."""
    cuts = f"select lang, run, cut, sum(case when same = 1 then x else 0.0e0 end) as s, sum(same) * 1.0e0 as k, sum(x) as sx, sum(x * x) as sxx, count(*) * 1.0e0 as n from (select z.lang, z.run, cut, x, case when i < cut and j >= cut then 0 else 1 end as same from (select xr.*, big.pages from xr join big on big.lang = xr.lang and big.run = xr.run) z {d.each('1', 'pages - 1', 'cut')}) y group by lang, run, cut"
    best = "select *, row_number() over (partition by lang, run order by round(e, 9), cut) as nth from (select *, sxx - s * s / k - (sx - s) * (sx - s) / (n - k) as e from cuts where k > 0) c"
    return f"""with {_smooth()}, cuts as ({cuts}), best as ({best})
        select f.lang, count(*) as runs, cast(sum(f.pages) as bigint) as pages, round(avg(b), 6) as slope, round(avg((c.sx - c.s) / (c.n - c.k) - c.s / c.k), 6) as step, round(sum(f.sxx - a * f.sx - b * f.sxr) / sum(f.n), 6) as line_error, round(sum(e) / sum(c.n), 6) as step_error
        from fitted f join best c on c.lang = f.lang and c.run = f.run and nth = 1 group by f.lang"""
