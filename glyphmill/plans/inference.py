"""Resampling and tests; p-values follow from their formulas."""

from __future__ import annotations

import math

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan

#: A statistic by language and source: share of words that end in a vowel, as numerator and denominator.
PARTS = "select lang, source, sum(case when right(tok, 1) in ('a','e','i','o','u') then 1.0e0 else 0.0e0 end) as num, count(*) * 1.0e0 as den from {tk} group by lang, source"
PAGES = "select lang, source, doc_id, sum(case when right(tok, 1) in ('a','e','i','o','u') then 1.0e0 else 0.0e0 end) as num, count(*) * 1.0e0 as den from {tk} group by lang, source, doc_id"


@plan("tk")
def jackknife(d: Spark) -> str:
    """Leave one source out, by taking its part off the totals: estimate, standard error, interval."""
    return f"""select lang, g as groups, round(full_, 6) as estimate, round(se, 6) as se, round(full_ - 1.96e0 * se, 6) as low, round(full_ + 1.96e0 * se, 6) as high from (
        select lang, count(*) as g, max(tn / td) as full_, case when count(*) > 1 then sqrt((count(*) - 1.0e0) / count(*) * sum((v - m) * (v - m))) end as se from (
          select *, avg(v) over (partition by lang) as m from (select lang, tn, td, (tn - num) / (td - den) as v from (select *, sum(num) over (partition by lang) as tn, sum(den) over (partition by lang) as td from ({PARTS}) p) q) r) s group by lang) t"""


@plan("tk")
def bootstrap(d: Spark) -> str:
    """Pages drawn with replacement a hundred times: interval by percentiles, and by order statistics. A page's number of draws is Poisson of mean 1, from a hash, as it nearly is among many pages; so no page is looked up by its rank."""
    u = d.u("concat('b', cast(rep as string), ':', cast(doc_id as string))")
    chances, below = [], 0.0
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        chances.append(f"when u < {below:.15f}e0 then {k}")
    draws = f"select rep, lang, num, den, case {' '.join(chances)} else 12 end as k from (select rep, lang, num, den, {u} as u from ({PAGES}) p {d.each('1', '100', 'rep')}) x"
    return f"""with reps as (select rep, lang, sum(k * num) / nullif(sum(k * den), 0.0e0) as v from ({draws}) w group by rep, lang)
        select lang, round({d.percentile('v', '0.025')}, 6) as low, round({d.percentile('v', '0.975')}, 6) as high, round(stddev_pop(v), 6) as sd, round(max(case when k = 3 then v end), 6) as low_order, round(max(case when k = 97 then v end), 6) as high_order
        from (select *, row_number() over (partition by lang order by v, rep) as k from reps where v is not null) q group by lang"""


@plan("tk")
def permutation_test(d: Spark) -> str:
    """Difference of two halves of a language's pages against halves dealt anew: p = (1 + as extreme) / (1 + deals)."""
    dealt = f"select rep, lang, num, den, case when rep = 0 then doc_id % 2 else cast({d.hash32("concat('h', cast(rep as string), ':', cast(doc_id as string))")} % 2 as bigint) end as half from ({PAGES}) p {d.each('0', '99', 'rep')}"
    return f"""select lang, round(max(case when rep = 0 then v end), 6) as difference, round((1 + sum(case when rep > 0 and abs(v) >= abs(obs) - 1e-12 then 1 else 0 end)) / 100.0e0, 6) as p from (select *, max(case when rep = 0 then v end) over (partition by lang) as obs from (
        select rep, lang, sum(case when half = 0 then num end) / sum(case when half = 0 then den end) - sum(case when half = 1 then num end) / sum(case when half = 1 then den end) as v from ({dealt}) z group by rep, lang) y) x group by lang"""


@plan("orders")
def welch_t(d: Spark) -> str:
    """Welch's t and its degrees of freedom for order values of each priority against all others."""
    return """select p, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t, round((v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1)), 4) as df from (
        select q.p, avg(case when o_orderpriority = q.p then o_totalprice end) as m1, avg(case when o_orderpriority <> q.p then o_totalprice end) as m0, var_samp(case when o_orderpriority = q.p then o_totalprice end) as v1, var_samp(case when o_orderpriority <> q.p then o_totalprice end) as v0,
          count(case when o_orderpriority = q.p then 1 end) as n1, count(case when o_orderpriority <> q.p then 1 end) as n0 from {orders} join (select distinct o_orderpriority as p from {orders}) q on o_totalprice is not null group by q.p) z"""


@plan("orders")
def mann_whitney(d: Spark) -> str:
    """Mann-Whitney's U of order values of two states, by average ranks, and its normal score. Ranks are counted inside steps of value and begin behind the steps below."""
    return """with o as (select o_orderstatus as s, o_totalprice as v, cast(floor(o_totalprice / 500) as bigint) as step from {orders} where o_orderstatus in ('F', 'O') and o_totalprice is not null),
        b as (select step, sum(n) over (order by step) - n as below from (select step, count(*) as n from o group by step) x),
        r as (select s, o.step, rank() over (partition by o.step order by v) + (count(*) over (partition by o.step, v) - 1) / 2.0e0 as rk from o),
        q as (select sum(case when s = 'F' then 1 else 0 end) * 1.0e0 as n1, sum(case when s = 'O' then 1 else 0 end) * 1.0e0 as n0, sum(case when s = 'F' then rk + below end) as s from r join b on r.step = b.step)
        select n1, n0, round(u, 1) as u, round((u - n1 * n0 / 2.0e0) / sqrt(n1 * n0 * (n1 + n0 + 1.0e0) / 12), 6) as z from (select n1, n0, s - n1 * (n1 + 1) / 2.0e0 as u from q) z"""


def _log_factorial(x: str) -> str:
    """ln(x!) by Stirling's series from x + 9 on."""
    shifted = "*".join(f"({x} + {k}.0e0)" for k in range(1, 9))
    return f"(({x} + 8.5e0) * ln({x} + 9.0e0) - ({x} + 9.0e0) + 0.918938533204672742e0 + 1.0e0 / (12 * ({x} + 9.0e0)) - 1.0e0 / (360 * pow({x} + 9.0e0, 3)) - ln({shifted}))"


@plan("labels")
def fisher_exact(d: Spark) -> str:
    """Fisher's exact test of the two labels' table, two-sided. Tables over 12 deviations off add nothing and are passed over."""
    f = _log_factorial
    reach = "(12 * sqrt(c1 * r1 / n * (r0 / n) * (c0 / greatest(n - 1, 1.0e0))) + 2)"
    prob = f"exp({f('r1')} + {f('r0')} + {f('c1')} + {f('c0')} - {f('n')} - {f('k')} - {f('(r1 - k)')} - {f('(c1 - k)')} - {f('(r0 - c1 + k)')})"
    cells = "select sum(case when quality = 1 and toxic = 1 then 1 else 0 end) * 1.0e0 as a, sum(case when quality = 1 then 1 else 0 end) * 1.0e0 as r1, sum(case when quality = 0 then 1 else 0 end) * 1.0e0 as r0, sum(case when toxic = 1 then 1 else 0 end) * 1.0e0 as c1, sum(case when toxic = 0 then 1 else 0 end) * 1.0e0 as c0, count(*) * 1.0e0 as n from {labels}"
    return f"select cast(max(a) as bigint) as a, round(sum(case when p <= pa * (1 + 1e-7) then p else 0.0e0 end), 6) as p from (select *, max(case when k = a then p end) over (partition by n) as pa from (select *, {prob} as p from (select c.*, k * 1.0e0 as k from (select *, greatest(0.0e0, c1 - r0, least(a, floor(c1 * r1 / n - {reach}))) as lo, least(c1, r1, greatest(a, ceil(c1 * r1 / n + {reach}))) as hi from ({cells}) t) c {d.each('lo', 'hi', 'k')}) x) y) z"


def _binomial(counts: str, by: str, p: str, d: Spark) -> str:
    """Two-sided binomial tests of k of n, columns of counts: chances no larger than that of k. Numbers over 12 deviations off add nothing and are passed over."""
    f = _log_factorial
    reach = f"(12 * sqrt(n * {p} * (1 - {p})) + 2)"
    prob = f"exp({f('n')} - {f('j')} - {f('(n - j)')} + j * ln({p}) + (n - j) * ln(1 - {p}))"
    numbers = f"select {by}, k, n, j * 1.0e0 as j from (select *, greatest(0.0e0, least(k, floor(n * {p} - {reach}))) as lo, least(n, greatest(k, ceil(n * {p} + {reach}))) as hi from ({counts}) c) b {d.each('lo', 'hi', 'j')}"
    return f"select {by}, cast(max(k) as bigint) as k, cast(max(n) as bigint) as n, round(sum(case when p <= pk * (1 + 1e-7) then p else 0.0e0 end), 6) as p from (select *, max(case when j = k then p end) over (partition by {by}) as pk from (select *, {prob} as p from ({numbers}) x) y) z group by {by}"


@plan("conversations")
def binomial_test(d: Spark) -> str:
    """Two-sided binomial test that a role has a third of the turns."""
    return _binomial("select role, count(*) * 1.0e0 as k, sum(count(*)) over (partition by 1) * 1.0e0 as n from {conversations} group by role", "role", "(1 / 3.0e0)", d)


@plan("conversations")
def sign_test(d: Spark) -> str:
    """Whether a role's turns are longer than the turn before them as often as shorter: ties left out, two-sided against a half."""
    steps = "select role, length(text) - lag(length(text)) over (partition by conv_id order by turn) as more from {conversations}"
    return _binomial(f"select role, sum(case when more > 0 then 1 else 0 end) * 1.0e0 as k, count(*) * 1.0e0 as n from ({steps}) s where more <> 0 group by role", "role", "0.5e0", d)


@plan("documents")
def spearman(d: Spark) -> str:
    """Rank correlation of ids and lengths by language; ties share ranks."""
    return "select lang, count(*) as n, round(corr(rx, ry), 6) as rho from (select lang, row_number() over (partition by lang order by doc_id) * 1.0e0 as rx, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0e0 as ry from {documents}) q group by lang"


@plan("tk")
def holm(d: Spark) -> str:
    """Sources against the rest by a normal test of vowel endings; p-values stepped down."""
    z = f"select lang, source, (num / den - (tn - num) / (td - den)) / sqrt(tn / td * (1 - tn / td) * (1 / den + 1 / (td - den))) as z from (select *, sum(num) over (partition by lang) as tn, sum(den) over (partition by lang) as td from ({PARTS}) p) q"
    p = "least(1.0e0, 2 * exp(-0.5e0 * z * z) / (sqrt(2 * 3.141592653589793e0) * (abs(z) + sqrt(z * z + 8 / 3.141592653589793e0)) / 2 + 1e-300))"
    return f"select lang, source, round(z, 6) as z, round(max(least(1.0e0, (m - r + 1) * p)) over (partition by lang order by r rows between unbounded preceding and current row), 6) as p_holm from (select *, row_number() over (partition by lang order by round(p, 12), source) as r, count(*) over (partition by lang) as m from (select lang, source, z, {p} as p from ({z}) a) b) c"


@plan("tk")
def tolerance(d: Spark) -> str:
    """Statistics of even pages within tolerance of those of odd ones: |g - v| <= 2 sqrt(se^2 + sd^2) + 0.01 |v|, spread by source."""
    halves = "select lang, doc_id % 2 as half, source, avg(length(tok) * 1.0e0) as len, avg(case when left(tok, 1) in ('a','e','i','o','u') then 1.0e0 else 0.0e0 end) as vowel from {tk} group by lang, doc_id % 2, source"
    tidy = f"select lang, half, 'len' as stat, len as v from ({halves}) a union all select lang, half, 'vowel' as stat, vowel as v from ({halves}) b"
    return f"""select r.lang, r.stat, round(r.v, 6) as real_, round(g.v, 6) as other_, abs(g.v - r.v) <= 2 * sqrt(r.se * r.se + g.sd * g.sd) + 0.01e0 * abs(r.v) as pass from (select lang, stat, avg(v) as v, sqrt((count(*) - 1.0e0) / count(*) * sum((w - mw) * (w - mw))) as se from (select *, avg(w) over (partition by lang, stat) as mw from (select lang, stat, v, (sum(v) over (partition by lang, stat) - v) / (count(*) over (partition by lang, stat) - 1) as w from ({tidy}) t where half = 0) u) s group by lang, stat) r
        join (select lang, stat, avg(v) as v, stddev_samp(v) as sd from ({tidy}) t where half = 1 group by lang, stat) g on r.lang = g.lang and r.stat = g.stat"""


@plan("tk")
def same_side(d: Spark) -> str:
    """Languages whose statistic lies on the same side of the whole's in both halves, and outside the whole's interval."""
    return f"""with p as ({PAGES}), whole as (select sum(num) / sum(den) as v, sqrt(sum(num) / sum(den) * (1 - sum(num) / sum(den)) / sum(den)) as se from p), h as (select lang, doc_id % 2 as half, sum(num) / sum(den) as v from p group by lang, doc_id % 2)
        select lang, round(min(h.v), 6) as low, round(max(h.v), 6) as high, (min(h.v) > max(w.v) or max(h.v) < max(w.v)) as same_side, (min(h.v) > max(w.v + 1.96e0 * w.se) or max(h.v) < max(w.v - 1.96e0 * w.se)) as outside from h join whole w on w.v is not null group by lang"""


@plan("lineitem")
def ols(d: Spark) -> str:
    """Least squares of price on quantity by return flag, with the mean square error."""
    return "select f.l_returnflag, round(max(b), 4) as slope, round(max(a), 4) as intercept, round(avg((y - a - b * x) * (y - a - b * x)), 2) as mse from (select l_returnflag, l_quantity as x, l_extendedprice as y from {lineitem}) r join (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from {lineitem} group by l_returnflag) f on r.l_returnflag = f.l_returnflag group by f.l_returnflag"
