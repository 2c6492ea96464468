"""Composites: many statistics of a corpus in one tidy table (lang, stat, value)."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import drift, inference, information, models, plan, words


def _tidy(d: Spark, text: str, *columns: str, where: str = "true", prefix: str = "") -> str:
    """Columns of a plan as rows (lang, stat, value); the plan is computed once."""
    names = " union all ".join(f"select '{prefix}{c}' as stat, {k} as k_" for k, c in enumerate(columns, 1))
    array = f"{d.array_name}({', '.join(f'cast({c} as double)' for c in columns)})"
    return f"select lang, stat, {d.item(array, 'k_')} as value from ({text}) t_ join ({names}) n_ on k_ > 0 where {where}"


def _line_entropy(d: Spark) -> str:
    """Bits of a character of a line given the 2, 3 and 4 before it; lines are words joined by blanks, with marked ends."""
    # a word with the four characters before it, which two words and their blanks hold, and the character behind it
    before = "right(concat('^^^^', case when p_.a = '' then '' else concat(p_.a, ' ') end, case when p_.b = '' then '' else concat(p_.b, ' ') end), 4)"
    padded = f"select lang, {d.size('words')} as n, {d.joined_arrays(d.array_name + '(' + repr('') + ', ' + repr('') + ')', 'words')} as words from b"
    pieces = f"select lang, t, count(*) as n from (select lang, concat({before}, p_.c, case when at_ = n - 1 then '$' else ' ' end) as t from ({padded}) w {d.runs('words', 'at_', 'p_')} where p_.c is not null) x group by lang, t"
    grams = " union all ".join(f"select lang, n, {k} as k, substr(t, cast(i as int) + {4 - k}, {k + 1}) as g, substr(t, cast(i as int) + {4 - k}, {k}) as ctx from c" for k in (2, 3, 4))
    return f"""with s as (select lang, t, n, cast(length(t) as bigint) - 4 as m from ({pieces}) l), c as (select lang, t, n, i from s {d.each('1', 'm', 'i')}), j as (select lang, k, g, ctx, sum(n) * 1.0e0 as n from ({grams}) g group by lang, k, g, ctx)
        select lang, concat('h', cast(k as string)) as stat, sum(h) / sum(n) as value from (select lang, k, sum(n) as n, -sum(n * log2(n)) as h from j group by lang, k union all select lang, k, 0.0e0, sum(n * log2(n)) from (select lang, k, ctx, sum(n) as n from j group by lang, k, ctx) x group by lang, k) y group by lang, k"""


def _lexicon(d: Spark) -> str:
    """Share of one half's words that the other half knows, and the share of words drawn from its letters' model of order 2 that it knows: the sum of the chances of all its words, up to 15 letters long."""
    half = d.hash32("concat('lx', cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))")
    grams = f"select lang, tok, n, len, substr(t, cast(i as int), 2) as ctx, substr(t, cast(i as int) + 2, 1) as sym from (select lang, tok, n, length(tok) as len, concat('^^', tok, '$') as t, cast(length(tok) as bigint) + 1 as m from k where h = 0) q {d.each('1', 'm', 'i')}"
    return f"""with k as (select lang, h, tok, count(*) as n from (select lang, tok, {half} % 2 as h from w) z group by lang, h, tok), g as ({grams}),
        p as (select lang, ctx, sym, sum(n) * 1.0e0 / sum(sum(n)) over (partition by lang, ctx) as p from g group by lang, ctx, sym),
        s as (select g.lang, g.tok, exp(sum(case when g.len = 15 and g.sym = '$' then 0.0e0 else ln(p) end)) as p from g join p on p.lang = g.lang and p.ctx = g.ctx and p.sym = g.sym where g.len <= 15 group by g.lang, g.tok)
        select x.lang, 'lex_real' as stat, sum(case when y.tok is null then 0 else x.n end) * 1.0e0 / sum(x.n) as value from (select * from k where h = 1) x left join (select * from k where h = 0) y on x.lang = y.lang and x.tok = y.tok group by x.lang
        union all select lang, 'lex_synth', sum(p) from s group by lang"""


def battery_text(d: Spark) -> str:
    """Rows (lang, stat, value) of the battery over lines of two words and more, from {lw} and {tk}: each corpus relation is read for one kind of statistic, and its columns become rows by a join with their names."""
    inner = f"select doc_id, lang, line_no, {d.slice('words', '2', d.size('words') + ' - 2')} as words from b where {d.size('words')} >= 5"
    sides = f"select lang, rep, stat, case when stat = 'edge_mi' then right(a, 1) else a end as a, case when stat = 'edge_mi' then left(b, 1) else b end as b from ({information.line_pairs(inner, information.SHUFFLES, d)}) x join (select 'edge_mi' as stat union all select 'token_mi') n on stat <> ''"
    key = "concat(cast(doc_id as string), ':', cast(line_no as string), ':', cast(at_ as string))"
    near = f"select doc_id, lang, line_no, at_, p_.a as a, p_.b as b, p_.c as b2 from ({inner}) i {d.runs('words', 'at_', 'p_')} where p_.b is not null"
    breaks = f"select lang, doc_id, line_no as at_, line_no, a, b from (select lang, doc_id, line_no, {d.item('words', '-1')} as a, lead({d.item('words', '1')}) over (partition by doc_id order by line_no) as b from b) z where b is not null"
    # as many inner pairs as breaks, or the other way round, by hashes of their places
    share = "select x.lang, least(x.n, y.n) * 1.0e0 / x.n as of_breaks, least(x.n, y.n) * 1.0e0 / y.n as of_near from (select lang, count(*) as n from breaks group by lang) x join (select lang, count(*) as n from near group by lang) y on x.lang = y.lang"
    # each pair is met once and stands for all statistics that a hash, or none, lets it count in
    kinds = "select 'd2_mi' as stat, '' as salt union all " + " union all ".join(f"select '{name}', 's{k}'" for k, name in enumerate(("adj_mi_same_n1", "adj_mi_same_n2", "adj_mi_same_n3", "adj_edge_same_n"), 1))
    inside = f"select t.lang, stat, case when stat = 'adj_edge_same_n' then right(a, 1) else a end as a, case when stat = 'd2_mi' then b2 when stat = 'adj_edge_same_n' then left(b, 1) else b end as b from near t join share s on s.lang = t.lang join ({kinds}) k on salt is not null where case when stat = 'd2_mi' then b2 is not null else {d.u(f'concat(salt, {key})')} < of_near end"
    across = f"select t.lang, stat, case when stat = 'break_edge' then right(a, 1) else a end as a, case when stat = 'break_edge' then left(b, 1) else b end as b from breaks t join share s on s.lang = t.lang join (select 'break_mi' as stat union all select 'break_edge') k on stat <> '' where {d.u(f'concat({chr(39)}s0{chr(39)}, {key})')} < of_breaks"
    pairs = f"{inside} union all {across} union all select lang, 'page_mi', cast(doc_id as string), tok from w"
    counts = "select lang, tok, count(*) as n from w group by lang, tok"
    basic = "select lang, sum(n) * 1.0e0 as tokens, count(*) * 1.0e0 as types, avg(case when n = 1 then 1.0e0 else 0.0e0 end) as hapax, count(*) * 1.0e0 / sum(n) as ttr, sum(n * length(tok)) * 1.0e0 / sum(n) as wlen, max(slope) as zipf from (select c.*, z.slope from c join z on z.lang = c.lang) x group by lang"
    names = ("tokens", "types", "hapax", "ttr", "wlen", "zipf")
    return f"""select lang, stat, value from (with b as (select doc_id, lang, line_no, words from {{lw}} where {d.size('words')} >= 2), w as (select doc_id, lang, line_no, pos, tok from {{tk}} where n_line >= 2),
          near as ({near}), breaks as ({breaks}), share as ({share}), c as ({counts}), z as (select lang, regr_slope(ln(n * 1.0e0), ln(r * 1.0e0)) as slope from (select lang, n, row_number() over (partition by lang order by n desc, tok) as r from c) q where r <= 200 group by lang)
        select lang, name as stat, {d.item(f"array_of({', '.join(names)})", "k").replace("array_of", d.array_name)} as value from ({basic}) t join ({' union all '.join(f"select '{n}' as name, {k} as k" for k, n in enumerate(names, 1))}) names on k > 0
        union all select lang, stat, max(case when rep = 0 then mi end) - avg(case when rep > 0 then mi end) from ({information.mi(sides, 'lang, stat, rep')}) m group by lang, stat
        union all select lang, stat, avg(value) from (select o.lang, {d.replace_all('o.stat', '[0-9]$', '')} as stat, o.mi - e.mi as value from ({information.mi(pairs, 'lang, stat')}) o join ({information.dealt(pairs, 'lang, stat', d)}) e on o.lang = e.lang and o.stat = e.stat) p group by lang, stat
        union all select * from ({_line_entropy(d)}) h union all select * from ({_lexicon(d)}) x
        union all select lang, 'space_gain', gain from ({information.space_gain(d)}) s) battery_"""


@plan("lw", "tk", "ty")
def battery(d: Spark) -> str:
    """The profile battery: 20 statistics of each language. Compressed size, the one SQL can't give, is the query compressed_size."""
    return f"select lang, stat, round(value, 6) as value from ({battery_text(d)}) q"


def tests_text(d: Spark) -> str:
    """Rows (lang, stat, value) of the tests of rhythm, recency, form and drift."""
    return " union all ".join([
        _tidy(d, drift.t1_line_break(d), "break_", "inner_", prefix="t1_"),
        _tidy(d, drift.t2a_final_form(d), "jsd", "length_final", "length_inner", prefix="t2a_"),
        _tidy(d, drift.t2c_dittography(d), "rate", "ratio", "rate2", prefix="t2c_"),
        _tidy(d, drift.t3a_zero_replication(d), "rho", prefix="t3a_"),
        f"select lang, concat('t3c_', place) as stat, cast(over_all as double) as value from ({words.position_entropy(d)}) l",
        f"select lang, 't4a_top' as stat, max(ratio) as value from ({drift.t4a_lag_profile(d)}) n group by lang",
        f"select lang, concat('t4b_', cast(k as string)) as stat, ratio as value from ({drift.t4b_columns(d)}) o",
        f"select lang, 't4c_top' as stat, max(ratio) as value from ({drift.t4c_line_cycle(d)}) o group by lang",
        _tidy(d, drift.t5_step_and_slope(d), "slope", "step", "line_error", "step_error", prefix="t5_"),
        _tidy(d, drift.t6a_decay(d), "decay", prefix="t6a_"),
        _tidy(d, drift.t6a_near(d), "decay", "mean_ratio", prefix="t6a_near_"),
    ])


@plan("tk", "ty", "pr", "tp", "ed1", "lw", "xs")
def test_profile(d: Spark) -> str:
    """The tests T1 to T6 that SQL can give, of each language in one table."""
    return f"select lang, stat, round(value, 6) as value from ({tests_text(d)}) q"


@plan("lw", "tk", "ty", "pr", "tp", "ed1", "xs")
def phenotype(d: Spark) -> str:
    """The battery with the tests, recency by line, drift, predictability and an interval: each statistic once."""
    more = " union all ".join([
        f"select lang, concat('e1_', kind) as stat, ratio as value from ({drift.e1_boundary_recency(d)}) e",
        _tidy(d, drift.e4_line_drift(d), "slope", prefix="e4_"),
        _tidy(d, models.heldout_bits(d), "bits", prefix="heldout_"),
        _tidy(d, inference.jackknife(d), "estimate", "se", prefix="vowel_"),
        f"select lang, concat('gap_', cast(gap as string)) as stat, mean_ed as value from ({information.adjacency_distance(d)}) g",
        _tidy(d, words.immediate_repeats(d), "pairs", "triples", prefix="repeat_"),
    ])
    return f"select lang, stat, round(value, 6) as value from ({battery_text(d)} union all {tests_text(d)} union all {more}) q"


@plan("lw", "tk", "ty")
def verdicts(d: Spark) -> str:
    """Languages by rules over their battery: word order tells something, spacing is regular, vocabulary is open."""
    return f"""select lang, case when edge > 0.02e0 then '+' when edge > 0.005e0 then '0' else '-' end as order_, case when space_ > 0.5e0 then '+' when space_ > 0.2e0 then '0' else '-' end as spacing, case when known < 0.8e0 then '+' else '-' end as open_ from (
        select lang, max(case when stat = 'edge_mi' then value end) as edge, max(case when stat = 'space_gain' then value end) as space_, max(case when stat = 'lex_real' then value end) as known from ({battery_text(d)}) q group by lang) z"""
