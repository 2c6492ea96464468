"""Distances between pages, sources and vectors."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan
from glyphmill.sources.corpus import RUN

#: Pages of 200 words and more, as profiles of first letters: (doc_id, lang, source, sym, p).
PROFILE = "select doc_id, lang, source, sym, c * 1.0e0 / n as p from (select doc_id, lang, source, left(tok, 1) as sym, count(*) as c, sum(count(*)) over (partition by doc_id) as n from {tk} group by doc_id, lang, source, left(tok, 1)) q where n >= 200"


def matrix() -> str:
    """Divergence of all pairs of pages of a source, through the letters they share: what only one page has adds half its share."""
    shared = "case when x.p > 0 then x.p * log2(2 * x.p / (x.p + y.p)) + y.p * log2(2 * y.p / (x.p + y.p)) - x.p - y.p else 0.0e0 end"
    return f"select x.source, x.doc_id as i, y.doc_id as j, x.lang as li, y.lang as lj, 1 + sum({shared}) / 2 as jsd from ({PROFILE}) x join ({PROFILE}) y on x.source = y.source and x.sym = y.sym and x.doc_id < y.doc_id group by x.source, x.doc_id, y.doc_id, x.lang, y.lang"


@plan("tk")
def page_jsd_matrix(d: Spark) -> str:
    return f"select source, i, j, round(jsd, 6) as jsd from ({matrix()}) m"


@plan("tk")
def jsd_by_relation(d: Spark) -> str:
    """Mean divergence of pages of one language, and of two."""
    return f"select case when li = lj then 'same' else 'other' end as relation, count(*) as pairs, round(avg(jsd), 6) as jsd from ({matrix()}) m group by 1"


@plan("tk")
def page_cosine(d: Spark) -> str:
    """Cosine similarity of pages of a source as word counts, the most similar ones: 0.5 and more."""
    counts = "select doc_id, source, tok, count(*) * 1.0e0 as c, sum(count(*) * count(*)) over (partition by doc_id) as q from {tk} group by doc_id, source, tok"
    return f"select i, j, round(cos, 6) as cosine from (select x.doc_id as i, y.doc_id as j, sum(x.c * y.c) / sqrt(max(x.q) * 1.0e0 * max(y.q)) as cos from ({counts}) x join ({counts}) y on x.source = y.source and x.tok = y.tok and x.doc_id < y.doc_id group by x.doc_id, y.doc_id) m where round(cos, 6) >= 0.5e0"


@plan("tk")
def hellinger(d: Spark) -> str:
    """Mean Hellinger distance of pages of a source by whether they share the language."""
    return f"select case when li = lj then 'same' else 'other' end as relation, count(*) as pairs, round(avg(sqrt(greatest(0.0e0, 2 - 2 * s))), 6) as distance from (select x.lang as li, y.lang as lj, sum(sqrt(x.p * y.p)) as s from ({PROFILE}) x join ({PROFILE}) y on x.source = y.source and x.sym = y.sym and x.doc_id < y.doc_id group by x.doc_id, y.doc_id, x.lang, y.lang) q group by 1"


def _components(d: Spark, extra: str = "") -> str:
    return f"select vec_id, label{extra}, i, cast({d.item('embedding', 'i')} as double) as x from {{embeddings}} {d.each('1', '64', 'i')}"


@plan("embeddings")
def standard_features(d: Spark) -> str:
    """Features brought to mean 0 and deviation 1; then each label's mean distance from the whole's mean."""
    return f"select label, count(distinct vec_id) as vectors, round(sqrt(avg(z * z)), 6) as spread from (select label, vec_id, (x - avg(x) over (partition by i)) / (stddev_pop(x) over (partition by i) + 1e-9) as z from ({_components(d)}) c) q group by label"


@plan("embeddings")
def label_distances(d: Spark) -> str:
    """Euclidean distances between the mean vectors of labels."""
    means = f"select label, i, avg(x) as m from ({_components(d)}) c group by label, i"
    return f"select a.label as la, b.label as lb, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) as distance from ({means}) a join ({means}) b on a.i = b.i and a.label < b.label group by a.label, b.label"


@plan("embeddings")
def leave_one_out(d: Spark) -> str:
    """Labels of vectors told by the nearest mean of all others, and how often that is right, against the most common label."""
    c = _components(d)
    sums = f"select label, i, sum(x) as s, count(*) as k from ({c}) c group by label, i"
    far = f"select v.vec_id, v.label, m.label as other, sum((v.x - (m.s - case when m.label = v.label then v.x else 0.0e0 end) / (m.k - case when m.label = v.label then 1 else 0 end)) * (v.x - (m.s - case when m.label = v.label then v.x else 0.0e0 end) / (m.k - case when m.label = v.label then 1 else 0 end))) as q from ({c}) v join ({sums}) m on v.i = m.i where m.k > 1 group by v.vec_id, v.label, m.label"
    return f"select count(*) as n, round(avg(case when label = told then 1.0e0 else 0.0e0 end), 6) as right_share, round(max(top) * 1.0e0 / count(*), 6) as common_share from (select vec_id, label, told, count(*) over (partition by label) as top from (select vec_id, label, other as told, row_number() over (partition by vec_id order by round(q, 9), other) as r from ({far}) f) g where r = 1) h"


@plan("pg", "pc")
def leave_one_out_radius(d: Spark) -> str:
    """Sources of pages told by the class whose pages are nearest on average, letter pairs as roots of shares, leaving out the page and its neighbours up to 0, 10 or 30 places away; how often that is right, against the nearest page beyond the radius and the most common source.

    Mean square distances follow from sums of classes, less those of the neighbours: pairs are formed inside the radius only.
    """
    best = "row_number() over (partition by lang, r, radius order by round((t - near_) / (k - near_n), 9) desc, other) as nth"
    return f"""with p as (select lang, source, run, place, run * {RUN} + place as r, grams from {{pg}}), v as (select p.lang, p.source, p.r, c.g, sqrt(c.c / p.grams) as x from p join {{pc}} c on c.lang = p.lang and c.run = p.run and c.place = p.place),
        classes as (select lang, source, g, sum(x) as s from v group by lang, source, g), sizes as (select lang, source, count(*) as k from p group by lang, source),
        whole as (select v.lang, v.r, c.source as other, sum(v.x * c.s) as t from v join classes c on c.lang = v.lang and c.g = v.g group by v.lang, v.r, c.source),
        blocks as (select *, cast(floor(r / {RUN}.0e0) as bigint) as block from v),
        dots as (select a.lang, a.r, b.r as q, sum(a.x * b.x) as s from (select * from blocks {d.each('block - 1', 'block + 1', 'beside')}) a join blocks b on b.lang = a.lang and b.g = a.g and b.block = a.beside and b.r between a.r - 30 and a.r + 30 group by a.lang, a.r, b.r),
        beside as (select a.lang, a.r, b.source as other, b.r as q from (select * from p {d.each('run - 1', 'run + 1', 'next_')}) a join p b on b.lang = a.lang and b.run = a.next_ and b.r between a.r - 30 and a.r + 30),
        near as (select n.lang, n.r, n.other, n.q, coalesce(s, 0.0e0) as s from beside n left join dots o on o.lang = n.lang and o.r = n.r and o.q = n.q),
        sums as (select lang, r, other, radius, sum(case when abs(q - r) <= radius then s else 0.0e0 end) as near_, sum(case when abs(q - r) <= radius then 1 else 0 end) as near_n from (select n.*, radius from near n join (select 0 as radius union all select 10 union all select 30) z on 1 = 1) y group by lang, r, other, radius),
        scored as (select w.lang, w.r, w.other, z.radius, t, k, coalesce(near_, 0.0e0) as near_, coalesce(near_n, 0) as near_n from whole w join sizes z0 on z0.lang = w.lang and z0.source = w.other join (select 0 as radius union all select 10 union all select 30) z on 1 = 1 left join sums s on s.lang = w.lang and s.r = w.r and s.other = w.other and s.radius = z.radius),
        told as (select lang, r, radius, other, classes_ from (select *, {best}, count(*) over (partition by lang, r, radius) as classes_ from scored where k > near_n) b where nth = 1 and classes_ >= 2),
        beyond as (select t.lang, t.r, t.radius, coalesce(a.source, b.source) as source from told t left join p a on a.lang = t.lang and a.r = t.r - t.radius - 1 left join p b on b.lang = t.lang and b.r = t.r + t.radius + 1),
        common as (select lang, max(k) * 1.0e0 / sum(k) as share from sizes group by lang)
        select t.lang, t.radius, count(*) as pages, round(avg(case when t.other = p.source then 1.0e0 else 0.0e0 end), 6) as right_share, round(avg(case when b.source = p.source then 1.0e0 when b.source is not null then 0.0e0 end), 6) as nearest_share, round(max(share), 6) as common_share
        from told t join p on p.lang = t.lang and p.r = t.r join beyond b on b.lang = t.lang and b.r = t.r and b.radius = t.radius join common c on c.lang = t.lang group by t.lang, t.radius"""


@plan("orders", "customer")
def gini(d: Spark) -> str:
    """Gini coefficient of order values by market segment; no value below 0."""
    return "select c_mktsegment as segment, count(*) as n, round(2 * sum(r * v) / (count(*) * sum(v)) - (count(*) + 1.0e0) / count(*), 6) as gini from (select c_mktsegment, greatest(o_totalprice, 0.0e0) as v, row_number() over (partition by c_mktsegment order by o_totalprice, o_orderkey) as r from {orders} o join {customer} c on o_custkey = c_custkey) q group by c_mktsegment"


@plan("tk")
def gini_consecutive(d: Spark) -> str:
    """How unevenly change is spread over consecutive pages of a language: Gini of divergences of first letters."""
    pages = "select doc_id, lang, lead(doc_id) over (partition by lang order by doc_id) as nxt from (select distinct doc_id, lang from ({p}) p) q".format(p=PROFILE)
    steps = f"select g.lang, g.doc_id, 1 + sum(x.p * log2(2 * x.p / (x.p + y.p)) + y.p * log2(2 * y.p / (x.p + y.p)) - x.p - y.p) / 2 as v from ({pages}) g join ({PROFILE}) x on x.doc_id = g.doc_id join ({PROFILE}) y on y.doc_id = g.nxt and x.sym = y.sym group by g.lang, g.doc_id"
    return f"select lang, count(*) as steps, round(2 * sum(r * v) / (count(*) * sum(v)) - (count(*) + 1.0e0) / count(*), 6) as gini from (select lang, v, row_number() over (partition by lang order by round(v, 9), doc_id) as r from ({steps}) s) q group by lang"


@plan("tk")
def mantel(d: Spark) -> str:
    """Rank correlation of page divergence with the distance of ids, by source, against pages dealt anew twenty times."""
    ids = f"select distinct source, doc_id from ({PROFILE}) p"
    ranked = f"select source, doc_id, row_number() over (partition by source order by doc_id) as r from ({ids}) a"
    dealt = f"select rep, source, doc_id, row_number() over (partition by rep, source order by md5(concat('m', cast(rep as string), ':', cast(doc_id as string))), doc_id) as r from ({ids}) a {d.each('0', '19', 'rep')}"
    deals = f"select 0 as kind, cast(-1 as bigint) as rep, a.source, a.doc_id, a.doc_id as other from ({ranked}) a union all select 1, b.rep, a.source, a.doc_id, b.doc_id from ({ranked}) a join ({dealt}) b on a.source = b.source and a.r = b.r"
    pairs = "select a.rep, m.source, m.i, m.j, round(m.jsd, 9) as x, abs(a.other - b.other) as y from m join p a on a.source = m.source and a.doc_id = m.i join p b on b.source = m.source and b.doc_id = m.j and b.rep = a.rep"
    rank = "rank() over (partition by rep, source order by {v}) + (count(*) over (partition by rep, source, {v}) - 1) / 2.0e0"
    return f"""with m as ({matrix()}), p as (select rep, source, doc_id, other from ({deals}) z),
        r as (select rep, source, {rank.format(v='x')} as rx, {rank.format(v='y')} as ry from ({pairs}) q), s as (select rep, source, corr(rx, ry) as rho from r group by rep, source)
        select o.source, round(o.rho, 6) as rho, round((1 + count(case when n.rho >= o.rho - 1e-9 then 1 end)) / 21.0e0, 6) as p from (select source, rho from s where rep = -1) o join (select source, rho from s where rep >= 0) n on o.source = n.source group by o.source, o.rho"""
