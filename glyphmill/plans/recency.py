"""Repeats by distance and by the lines and paragraphs between them, over what classes of places give (E1)."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark, poisson
from glyphmill.plans import plan

#: Words between a word and those that it is compared with, at most.
REACH = 40
#: Pages are drawn in so many groups, whatever their number; draws.
GROUPS, DRAWS = 128, 500


def close(d: Spark, words: str, on: str = "y.tok = x.tok", columns: str = "x.doc_id, x.lang, y.idx - x.idx as dist", extra: str = "") -> str:
    """Pairs of a page's words, by an equality, that stand 2 to REACH places apart: joined by blocks of places, so a word that is said over and over meets its neighbours alone."""
    block = f"cast(floor(idx / {REACH}.0e0) as bigint)"
    return f"""select {columns} from (select * from (select *, {block} as block from {words}) w {d.each('block', 'block + 1', 'near')}) x {extra}
        join (select *, {block} as block from {words}) y on y.doc_id = x.doc_id and y.block = x.near and {on} and y.idx between x.idx + 2 and x.idx + {REACH}"""


def ahead(d: Spark, words: str, code: str, keys: str, reach: int = REACH) -> str:
    """Every word's code with those 2 to reach places behind it on its page, (keys, x, y, dist): one sort of the page, no join."""
    leads = ", ".join(f"lead({code}, {k}) over (partition by doc_id order by idx)" for k in range(2, reach + 1))
    return f"select {keys}, x, y, at_ + 2 as dist from (select {keys}, {code} as x, {d.array_name}({leads}) as ys from {words}) a {d.numbered('ys', 'at_', 'y')} where x is not null and y is not null"


def _words(d: Spark) -> str:
    """Words with their place on the page, line, paragraph, and class: how far from the ends of the line, up to two, and whether the line ends its paragraph. First and last words of lines, and first lines of paragraphs, have no class.

    code holds paragraph, line and class. A line without words ends a paragraph.
    """
    n = d.size("words")
    lines = f"""select lang, doc_id, line_no, words, cast({n} as bigint) as n, sum({n}) over (partition by doc_id order by line_no) - {n} as before,
        sum(case when {n} = 0 then 1 else 0 end) over (partition by doc_id order by line_no) as para, case when coalesce(lag({n}) over (partition by doc_id order by line_no), 0) = 0 then 1 else 0 end as first_, case when coalesce(lead({n}) over (partition by doc_id order by line_no), 0) = 0 then 1 else 0 end as last_ from {{lw}}"""
    cls = "case when first_ = 0 and pos > 0 and pos < n - 1 then (least(pos, 2) - 1) * 4 + (least(n - 1 - pos, 2) - 1) * 2 + last_ end"
    return f"select lang, doc_id, line_no, para, idx, tok, cls, (para * 16777216 + line_no) * 64 + cls as code from (select lang, doc_id, line_no, cast(para as bigint) as para, cast(before + pos as bigint) as idx, tok, cast({cls} as bigint) as cls from (select * from ({lines}) l {d.numbered('words', 'pos', 'tok')}) m) o"


def _kinds(value: str) -> str:
    """Sums of a value over pairs in one line, in neighbouring lines of a paragraph, in different lines of one, and in two."""
    return f"sum(case when lx = ly then {value} else 0.0e0 end) as {{0}}_same, sum(case when ly = lx + 1 and px = py then {value} else 0.0e0 end) as {{0}}_next, sum(case when ly <> lx and px = py then {value} else 0.0e0 end) as {{0}}_para, sum(case when px <> py then {value} else 0.0e0 end) as {{0}}_cross"


@plan("lw", "ed1")
def e1_steps(d: Spark) -> str:
    """Repeats, exact or one edit apart, by distance and by what lies between, over what words dealt anew inside their classes of places give: decline inside lines (wld) and paragraphs (wpd), and the steps at line and paragraph ends (ls, ps), with 95 % intervals from draws of pages.

    Pages with fewer than ten words of a class are left out. Ratios are of sums over pages; a step weighs distances by the smaller expectation.
    """
    split = "cast((c_ - c_ % 64) / 64 as bigint)"
    place = lambda c: (f"{c} % 64", split.replace("c_", c) + " % 16777216", f"cast(({split.replace('c_', c)} - {split.replace('c_', c)} % 16777216) / 16777216 as bigint)")
    (cx, lx, px), (cy, ly, py) = place("x"), place("y")
    pairs = f"select lang, doc_id, dist, {cx} as cx, {cy} as cy, {lx} as lx, {ly} as ly, {px} as px, {py} as py from ({ahead(d, 'w', 'code', 'lang, doc_id')}) a"
    kinds = "select lang, doc_id, dist, cx, cy, {0} from pairs group by lang, doc_id, dist, cx, cy".format(_kinds("1.0e0").format("n"))
    columns = "x.lang, x.doc_id, y.idx - x.idx as dist, x.line_no as lx, y.line_no as ly, x.para as px, y.para as py"
    same = close(d, "w", "y.tok = x.tok and x.cls is not null and y.cls is not null", columns)
    near = close(d, "w", "y.tok = e.b and x.cls is not null and y.cls is not null", columns, "join {ed1} e on e.a = x.tok")
    sums = [f"{s}_{k}" for s in ("s", "e") for k in ("same", "next", "para", "cross")]
    names = ("same", "next", "para", "cross")
    ratio = ", ".join(f"s_{k} / greatest(e_{k}, 1e-12) as r_{k}" for k in names)
    step = lambda a, b, low, high: f"sum(case when dist between {low} and {high} then least(e_{a}, e_{b}) * (r_{b} - r_{a}) end) / nullif(sum(case when dist between {low} and {high} then least(e_{a}, e_{b}) end), 0.0e0)"
    mean = lambda k, low, high: f"avg(case when dist between {low} and {high} then r_{k} end)"
    stats = {"wld": f"{mean('same', 2, 3)} - {mean('same', 5, 7)}", "ls": step("same", "next", 2, 7), "ps": step("para", "cross", 8, REACH), "wpd": f"{mean('para', 8, 15)} - {mean('para', 25, REACH)}"}
    rows = " union all ".join(f"select lang, rep, '{k}' as stat, {k} as v from steps" for k in stats)
    group = f"cast({d.hash32("concat('e1', cast(doc_id as string))")} % {GROUPS} as bigint)"
    return f"""with w as ({_words(d)}), pairs as ({pairs}), k as (select doc_id, cls, tok, count(*) * 1.0e0 as k from w where cls is not null group by doc_id, cls, tok), n as (select doc_id, cls, sum(k) as n from k group by doc_id, cls),
        big as (select doc_id from n group by doc_id having sum(n) >= 10),
        alike as (select x.doc_id, x.cls as cx, y.cls as cy, sum(x.k * (y.k - case when x.cls = y.cls then 1 else 0 end)) as s from k x join k y on y.doc_id = x.doc_id and y.tok = x.tok group by x.doc_id, x.cls, y.cls
            union all select x.doc_id, x.cls, y.cls, sum(x.k * y.k) from k x join {{ed1}} e on e.a = x.tok join k y on y.doc_id = x.doc_id and y.tok = e.b group by x.doc_id, x.cls, y.cls),
        chance as (select a.doc_id, a.cls as cx, b.cls as cy, coalesce(s, 0.0e0) / (a.n * (b.n - case when a.cls = b.cls then 1 else 0 end)) as p from n a join n b on b.doc_id = a.doc_id and (a.cls <> b.cls or a.n > 1) left join (select doc_id, cx, cy, sum(s) as s from alike group by doc_id, cx, cy) z on z.doc_id = a.doc_id and z.cx = a.cls and z.cy = b.cls),
        expected as (select q.lang, q.doc_id, dist, {", ".join(f"sum(n_{k} * p) as e_{k}" for k in names)} from ({kinds}) q join chance c on c.doc_id = q.doc_id and c.cx = q.cx and c.cy = q.cy group by q.lang, q.doc_id, dist),
        hits as (select doc_id, dist, {_kinds("1.0e0").format("s")} from ({same} union all {near}) h group by doc_id, dist),
        page_ as (select e.lang, {group.replace('doc_id', 'e.doc_id')} as grp, e.dist, {", ".join(f"coalesce(s_{k}, 0.0e0) as s_{k}, e_{k}" for k in names)} from expected e join big on big.doc_id = e.doc_id left join hits h on h.doc_id = e.doc_id and h.dist = e.dist),
        grouped as (select lang, grp, dist, {", ".join(f"sum({c}) as {c}" for c in sums)} from page_ group by lang, grp, dist),
        weights as (select lang, grp, rep, case when rep = 0 then 1 else {poisson('u')} end as wt from (select lang, grp, rep, {d.u("concat('e1', lang, cast(grp as string), ':', cast(rep as string))")} as u from (select * from (select distinct lang from {{lw}}) l {d.each('0', str(GROUPS - 1), 'grp')}) g {d.each('0', str(DRAWS), 'rep')}) v),
        profile as (select g.lang, rep, dist, {", ".join(f"sum(wt * {c}) as {c}" for c in sums)} from grouped g join weights t on t.lang = g.lang and t.grp = g.grp group by g.lang, rep, dist),
        steps as (select lang, rep, {", ".join(f"{v} as {k}" for k, v in stats.items())} from (select *, {ratio} from profile) r group by lang, rep),
        tidy as ({rows})
        select t.lang, t.stat, round(max(case when rep = 0 then v end), 6) as value, round({d.percentile('case when rep > 0 then v end', '0.025')}, 6) as low, round({d.percentile('case when rep > 0 then v end', '0.975')}, 6) as high from tidy t group by t.lang, t.stat"""


def _draws(d: Spark, table: str, mark: str, by: str, columns: list[str]) -> str:
    """Sums of columns of a table (lang, doc_id, by, columns) over pages that are drawn in groups: (lang, rep, by, columns), rep 0 has each page once."""
    group = f"cast({d.hash32(f"concat('{mark}', cast(doc_id as string))")} % {GROUPS} as bigint)"
    grouped = f"select lang, {group} as grp, {by}, {', '.join(f'sum({c}) as {c}' for c in columns)} from {table} group by lang, {group}, {by}"
    u = d.u(f"concat('{mark}', lang, cast(grp as string), ':', cast(rep as string))")
    weights = f"select lang, grp, rep, case when rep = 0 then 1 else {poisson('u')} end as wt from (select lang, grp, rep, {u} as u from (select * from (select distinct lang from {{lw}}) l {d.each('0', str(GROUPS - 1), 'grp')}) g {d.each('0', str(DRAWS), 'rep')}) v"
    return f"select g.lang, rep, {by}, {', '.join(f'sum(wt * {c}) as {c}' for c in columns)} from ({grouped}) g join ({weights}) t on t.lang = g.lang and t.grp = g.grp group by g.lang, rep, {by}"


def _tidy(d: Spark, stats: tuple[str, ...], table: str) -> str:
    rows = " union all ".join(f"select lang, rep, '{k}' as stat, {k} as v from {table}" for k in stats)
    return f"select lang, stat, round(max(case when rep = 0 then v end), 6) as value, round({d.percentile('case when rep > 0 then v end', '0.025')}, 6) as low, round({d.percentile('case when rep > 0 then v end', '0.975')}, 6) as high from ({rows}) t group by lang, stat"


@plan("lw")
def e1_graded(d: Spark) -> str:
    """How alike words 2 to 7 places apart are, 1 less edits over the longer one's letters, over what pairs of their classes of places on the page are on average (25 picked by hashes): decline inside lines and the step at their ends."""
    place = lambda c: (f"cast(substr({c}, 1, 1) as bigint)", f"cast(substr({c}, 3, instr({c}, '/') - 3) as bigint)", f"cast(substr({c}, instr({c}, '/') + 1, instr({c}, ' ') - instr({c}, '/') - 1) as bigint)", f"substr({c}, instr({c}, ' ') + 1)")
    (cx, lx, px, tx), (cy, ly, py, ty) = place("x"), place("y")
    code = "case when cls is not null then concat(cast(cls as string), ':', cast(line_no as string), '/', cast(para as string), ' ', tok) end"
    pairs = f"select lang, doc_id, dist, cx, cy, tx, ty, case when lx = ly then 'same' else 'next' end as kind from (select lang, doc_id, dist, {cx} as cx, {cy} as cy, {lx} as lx, {ly} as ly, {px} as px, {py} as py, {tx} as tx, {ty} as ty from ({ahead(d, 'w', code, 'lang, doc_id', 7)}) a) b where lx = ly or (ly = lx + 1 and px = py)"
    alike = lambda a, b: f"1 - {d.edits(a, b)} * 1.0e0 / greatest(length({a}), length({b}))"
    pick = lambda side: d.u(f"concat('{side}', cast(doc_id as string), ':', cast(cx as string), cast(cy as string), ':', cast(pick as string))")
    both = f"select * from (select a.doc_id, a.cls as cx, a.n as nx, b.cls as cy, b.n as ny from sizes a join sizes b on b.doc_id = a.doc_id) c {d.each('1', '25', 'pick')}"
    picks = f"select doc_id, cx, cy, cast(floor({pick('ex')} * nx) as bigint) as ix, cast(floor({pick('ey')} * ny) as bigint) as iy from ({both}) o"
    mean = lambda low, high: f"avg(case when dist between {low} and {high} and e_same > 0 then s_same / e_same end)"
    step = "sum(least(e_same, e_next) * (s_next / greatest(e_next, 1e-12) - s_same / greatest(e_same, 1e-12))) / nullif(sum(least(e_same, e_next)), 0.0e0)"
    sums = ", ".join(f"sum(case when kind = '{k}' then {v} else 0.0e0 end) as {c}_{k}" for k in ("same", "next") for c, v in (("s", "s"), ("e", "e")))
    return f"""with w as ({_words(d)}), classed as (select doc_id, cls, tok, row_number() over (partition by doc_id, cls order by idx) - 1 as nth from w where cls is not null), sizes as (select doc_id, cls, count(*) as n from classed group by doc_id, cls),
        big as (select doc_id as d_ from sizes group by doc_id having sum(n) >= 10), picks as ({picks}),
        chance as (select p.doc_id, p.cx, p.cy, avg({alike('x.tok', 'y.tok')}) as g from picks p join classed x on x.doc_id = p.doc_id and x.cls = p.cx and x.nth = p.ix join classed y on y.doc_id = p.doc_id and y.cls = p.cy and y.nth = p.iy group by p.doc_id, p.cx, p.cy),
        seen as (select lang, doc_id, dist, kind, cx, cy, count(*) as n, sum({alike('tx', 'ty')}) as s from ({pairs}) p group by lang, doc_id, dist, kind, cx, cy),
        page_ as (select lang, doc_id, dist, {sums} from (select s.lang, s.doc_id, s.dist, s.kind, s.s, s.n * c.g as e from seen s join big on d_ = s.doc_id join chance c on c.doc_id = s.doc_id and c.cx = s.cx and c.cy = s.cy) q group by lang, doc_id, dist),
        profile as ({_draws(d, 'page_', 'eg', 'dist', ['s_same', 'e_same', 's_next', 'e_next'])}), steps as (select lang, rep, {mean(2, 3)} - {mean(5, 7)} as wld, {step} as ls from profile group by lang, rep)
        {_tidy(d, ('wld', 'ls'), 'steps')}"""


#: Lines of a page that are compared are so many apart at most; words of more letters are near to equal ones alone.
LINES_APART, LETTERS = 40, 24


@plan("lw")
def e4_sublexical(d: Spark) -> str:
    """How lines of a page drift apart, in words and below: slopes over 2 to 8 lines of the cosine of lines as word counts, and of what is left of both lines as letter pairs when words with a near match (two edits or fewer) in the other line are taken out, over the page's means; with 95 % intervals from draws of pages.

    Pages of six lines and more. Near words of a page meet by what is left of them when up to two letters go.
    """
    lines = f"select lang, doc_id, words, row_number() over (partition by doc_id order by line_no) as l, count(*) over (partition by doc_id) as lines_ from {{lw}} where {d.size('words')} > 0"
    gone1 = f"select doc_id, tok, concat(substr(tok, 1, cast(i as int) - 1), substr(tok, cast(i as int) + 1)) as v from (select doc_id, tok, cast(length(tok) as bigint) as m from short_) q {d.each('1', 'm', 'i')}"
    gone2 = f"select doc_id, tok, concat(substr(tok, 1, cast(i as int) - 1), substr(tok, cast(i as int) + 1, cast(j - i as int) - 1), substr(tok, cast(j as int) + 1)) as v from (select * from (select doc_id, tok, cast(length(tok) as bigint) as m from short_) q {d.each('1', 'm - 1', 'i')}) r {d.each('i + 1', 'm', 'j')}"
    # both lines' pairs side by side; as many words are left as pairs begin with the mark
    cells = f"select doc_id, lo, hi, substr(w, cast(k as int), 2) as g, sum(case when side = 0 then c else 0.0e0 end) as vi, sum(case when side = 1 then c else 0.0e0 end) as vj from (select doc_id, least(i, j) as lo, greatest(i, j) as hi, case when i < j then 0 else 1 end as side, c, concat('^', tok, '$') as w, cast(length(tok) + 1 as bigint) as m from kept) q {d.each('1', 'm', 'k')} group by doc_id, lo, hi, substr(w, cast(k as int), 2)"
    ratio = lambda c: f"sum({c}) / nullif(sum({c}_e), 0.0e0)"
    return f"""with ln_ as (select * from ({lines}) l where lines_ >= 6), lt as (select lang, doc_id, l, tok, count(*) * 1.0e0 as c from ln_ {d.items('words', 'tok')} group by lang, doc_id, l, tok),
        types_ as (select distinct doc_id, tok from lt), short_ as (select * from types_ where length(tok) <= {LETTERS}),
        sketches as (select distinct doc_id, tok, v from (select doc_id, tok, tok as v from short_ union all {gone1} union all {gone2}) s),
        near as (select doc_id, a, b from (select distinct x.doc_id, x.tok as a, y.tok as b from sketches x join sketches y on y.doc_id = x.doc_id and y.v = x.v) z where {d.within('a', 'b', 2)} union all select doc_id, tok, tok from types_ where length(tok) > {LETTERS}),
        hit as (select distinct x.doc_id, x.l as i, y.l as j, x.tok from lt x join near n on n.doc_id = x.doc_id and n.a = x.tok join lt y on y.doc_id = n.doc_id and y.tok = n.b where abs(y.l - x.l) between 2 and {LINES_APART}),
        kept as (select p.doc_id, p.i, p.j, p.tok, p.c from (select t.doc_id, t.l as i, o.l as j, t.tok, t.c from lt t join ln_ o on o.doc_id = t.doc_id and abs(o.l - t.l) between 2 and {LINES_APART}) p left join hit h on h.doc_id = p.doc_id and h.i = p.i and h.j = p.j and h.tok = p.tok where h.tok is null),
        sub as (select doc_id, lo as i, hi as j, sum(vi * vj) / sqrt(sum(vi * vi) * sum(vj * vj)) as sub from ({cells}) z group by doc_id, lo, hi having sum(case when left(g, 1) = '^' then vi end) >= 2 and sum(case when left(g, 1) = '^' then vj end) >= 2),
        whole as (select doc_id, l, sum(c * c) as q from lt group by doc_id, l),
        same as (select x.doc_id, x.l as i, y.l as j, sum(x.c * y.c) as s from lt x join lt y on y.doc_id = x.doc_id and y.tok = x.tok and y.l - x.l between 2 and {LINES_APART} group by x.doc_id, x.l, y.l),
        lex as (select a.lang, a.doc_id, a.l as i, b.l as j, coalesce(s, 0.0e0) / sqrt(p.q * r.q) as lex from ln_ a join ln_ b on b.doc_id = a.doc_id and b.l - a.l between 2 and {LINES_APART} join whole p on p.doc_id = a.doc_id and p.l = a.l join whole r on r.doc_id = b.doc_id and r.l = b.l left join same o on o.doc_id = a.doc_id and o.i = a.l and o.j = b.l),
        every as (select e.lang, e.doc_id, e.j - e.i as k, lex, sub, avg(lex) over (partition by e.doc_id) as lex_mean, avg(sub) over (partition by e.doc_id) as sub_mean from lex e left join sub u on u.doc_id = e.doc_id and u.i = e.i and u.j = e.j),
        page_ as (select lang, doc_id, k, sum(lex) as lex, sum(lex_mean) as lex_e, sum(coalesce(sub, 0.0e0)) as sub, sum(case when sub is not null then sub_mean else 0.0e0 end) as sub_e from every where k <= 8 and sub_mean is not null group by lang, doc_id, k),
        profile as ({_draws(d, 'page_', 'e4', 'k', ['lex', 'lex_e', 'sub', 'sub_e'])}),
        slopes as (select lang, rep, regr_slope(lex, k) as lexical, regr_slope(sub, k) as sublexical from (select lang, rep, k * 1.0e0 as k, {ratio('lex')} as lex, {ratio('sub')} as sub from profile group by lang, rep, k) r group by lang, rep)
        {_tidy(d, ('lexical', 'sublexical'), 'slopes')}"""
