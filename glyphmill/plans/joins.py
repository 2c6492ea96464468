"""Joins that compare words, places and pages."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan


@plan("ed1")
def ed1_degree(d: Spark) -> str:
    """Types by the number of types at distance 1."""
    return "select degree, count(*) as types from (select a, count(*) as degree from {ed1} group by a) q group by degree"


@plan("ed1")
def ed1_pairs(d: Spark) -> str:
    return "select a, b from {ed1}"


@plan("tk", "benchmark")
def label_attestation(d: Spark) -> str:
    """Share of the benchmark's words that the pages of a source know."""
    words = d.find_all("lower(text)", r"[\p{{L}}\p{{Nl}}\p{{No}}]+")
    labels = f"select distinct tok from (select {words} as words from {{benchmark}}) q {d.items('words', 'tok')}"
    return f"select s.source, count(*) as labels, round(avg(case when t.tok is null then 0.0e0 else 1.0e0 end), 6) as attested from (select distinct source from {{tk}}) s join ({labels}) l on length(l.tok) > 0 left join (select distinct source, tok from {{tk}}) t on t.source = s.source and t.tok = l.tok group by s.source"


@plan("benchmark")
def label_letters(d: Spark) -> str:
    """First letters of the benchmark's words: words, types, and words met more than once."""
    words = d.find_all("lower(text)", r"[\p{{L}}\p{{Nl}}\p{{No}}]+")
    counted = f"select tok, count(*) as n from (select {words} as words from {{benchmark}}) q {d.items('words', 'tok')} group by tok"
    return f"select left(tok, 1) as letter, cast(sum(n) as bigint) as words, count(*) as types, sum(case when n > 1 then 1 else 0 end) * 1.0e0 as repeated from ({counted}) c group by left(tok, 1)"


@plan("tk")
def recurrence(d: Spark) -> str:
    """Types met on one page only, and on several."""
    return "select lang, count(*) as types, sum(case when pages > 1 then 1 else 0 end) * 1.0e0 as recurring, max(pages) as most from (select lang, tok, count(distinct doc_id) as pages from {tk} group by lang, tok) q group by lang"


@plan("tk")
def unseen_elsewhere(d: Spark) -> str:
    """Types of a source that no other source of the language has."""
    return "select source, count(*) as types from (select lang, tok, min(source) as source, count(distinct source) as k from {tk} group by lang, tok) q where k = 1 group by source"


@plan("lw")
def aligned_readings(d: Spark) -> str:
    """Two readings of a line, here those of a page and the one 100 ids further: lines with as many words are compared word by word."""
    pairs = f"select a.lang, a.words as x, b.words as y from {{lw}} a join {{lw}} b on b.doc_id = a.doc_id + 100 and b.line_no = a.line_no and b.lang = a.lang where {d.size('a.words')} > 0"
    words = f"select lang, w, {d.item('y', 'at_ + 1')} as v from (select * from p where {d.size('x')} = {d.size('y')}) l {d.numbered('x', 'at_', 'w')}"
    return f"""with p as ({pairs}), w as ({words}), l as (select lang, count(*) as lines, sum(case when {d.size('x')} = {d.size('y')} then 1 else 0 end) * 1.0e0 as aligned from p group by lang)
        select l.lang, lines, aligned, coalesce(words, 0) as words, round(same, 6) as same, round(mean_ed, 6) as mean_ed from l left join (select lang, count(*) as words, avg(case when w = v then 1.0e0 else 0.0e0 end) as same, avg({d.edits('w', 'v')} * 1.0e0) as mean_ed from w group by lang) c on c.lang = l.lang"""


def _distances(pairs: str, by: str, d: Spark) -> str:
    """Mean edit distance of pairs (a, b), and shares of those at most 0, 1 and 2 apart."""
    return f"""select {by}, count(*) as n, round(avg(ed * 1.0e0), 6) as mean_ed, round(avg(case when ed = 0 then 1.0e0 else 0.0e0 end), 6) as p0, round(avg(case when ed <= 1 then 1.0e0 else 0.0e0 end), 6) as p1, round(avg(case when ed <= 2 then 1.0e0 else 0.0e0 end), 6) as p2
        from (select {by}, case when a = b then 0 else {d.edits('a', 'b')} end as ed from ({pairs}) p_) q_ group by {by}"""


PLACE = "concat(cast(doc_id as string), ':', cast(line_no as string), ':', cast(pos as string))"


@plan("tk")
def vertical_neighbours(d: Spark) -> str:
    """Words against the one before, those above at the same place and beside it, that two lines above, and ones at random of the page and of the language."""
    key = f"md5(concat('v', {PLACE}))"
    beside = f"""select lang, doc_id, lag(tok) over (partition by doc_id, line_no order by pos) as prev, lead(tok) over (partition by doc_id order by {key}) as page, tok, {key} as key_ from {{tk}}"""
    anywhere = f"select lang, tok, lead(tok) over (partition by lang, substr(key_, 1, 2) order by key_) as other from ({beside}) r"
    lines = " union all ".join(f"select x.lang, '{name}' as relation, x.tok as a, y.tok as b from {{tk}} x join {{tk}} y on y.doc_id = x.doc_id and y.line_no = x.line_no - {up} and y.pos = x.pos + {off}" for name, up, off in (("above", 1, 0), ("above_left", 1, -1), ("above_right", 1, 1), ("two_above", 2, 0)))
    pairs = f"""{lines} union all select lang, 'before', tok, prev from ({beside}) b1 where prev is not null
        union all select lang, 'same_page', tok, page from ({beside}) b2 where page is not null union all select lang, 'same_language', tok, other from ({anywhere}) b3 where other is not null"""
    return _distances(pairs, "lang, relation", d)


@plan("tk")
def best_above(d: Spark) -> str:
    """The least distance of a word to the three above it, and, as a fair control, to three at random of its page."""
    key = f"md5(concat('v', {PLACE}))"
    beside = [f"select x.lang, x.doc_id, x.line_no, x.pos, x.tok as a, y.tok as b from {{tk}} x join {{tk}} y on x.doc_id = y.doc_id and y.line_no = x.line_no - 1 and y.pos = x.pos + {o}" for o in ("(-1)", "0", "1")]
    above = f"select lang, 'above' as kind, min(case when a = b then 0 else {d.edits('a', 'b')} end) as ed from ({' union all '.join(beside)}) u group by lang, doc_id, line_no, pos"
    leads = "select lang, line_no, tok, " + ", ".join(f"lead(tok, {k}) over (partition by doc_id order by {key}) as b{k}" for k in (1, 2, 3)) + " from {tk}"
    page = f"select lang, 'page' as kind, least({', '.join(d.edits('tok', f'b{k}') for k in (1, 2, 3))}) as ed from ({leads}) v where line_no > 0 and b3 is not null"
    return f"select lang, kind, cast(least(ed, 6) as bigint) as ed, count(*) as n from ({above} union all {page}) q group by lang, kind, least(ed, 6)"


@plan("tk")
def line_corners(d: Spark) -> str:
    """Ends of consecutive lines: how often letters agree for last-first, first-first and last-last."""
    ends = "select lang, doc_id, line_no, max_by(tok, pos) as l, min_by(tok, pos) as f from {tk} where n_line >= 2 group by lang, doc_id, line_no"
    return f"""select x.lang, count(*) as n, round(avg(case when right(x.l, 1) = left(y.f, 1) then 1.0e0 else 0.0e0 end), 6) as last_first, round(avg(case when left(x.f, 1) = left(y.f, 1) then 1.0e0 else 0.0e0 end), 6) as first_first, round(avg(case when right(x.l, 1) = right(y.l, 1) then 1.0e0 else 0.0e0 end), 6) as last_last
        from ({ends}) x join ({ends}) y on x.doc_id = y.doc_id and y.line_no = x.line_no + 1 group by x.lang"""


@plan("tk")
def new_words_of_lines(d: Spark) -> str:
    """Words of a line without any word within two edits in the line before."""
    return f"""with w as (select distinct lang, doc_id, line_no, tok from {{tk}})
        select x.lang, count(*) as n from w x where x.line_no > 0 and not exists (select 1 from w y where y.doc_id = x.doc_id and y.line_no = x.line_no - 1 and {d.within('x.tok', 'y.tok', 2)}) group by x.lang"""


@plan("documents")
def nearest_page(d: Spark) -> str:
    """For every page the nearest one of its language and source that is six or more ids away: a tie goes to the smaller."""
    near = "over (partition by lang, source order by doc_id range between"
    sides = f"select doc_id, max(doc_id) {near} unbounded preceding and 6 preceding) as low, min(doc_id) {near} 6 following and unbounded following) as high from {{documents}} where doc_id is not null"
    return f"select doc_id, nearest, abs(doc_id - nearest) as gap from (select distinct doc_id, case when high is null or doc_id - low <= high - doc_id then low else high end as nearest from ({sides}) s) q where nearest is not null"


@plan("documents")
def distance_bands(d: Spark) -> str:
    """Pairs of pages of a source by how far apart their ids are, counted by running counts."""
    bands = {"d020": (1, 20), "d060": (21, 60), "d140": (61, 140), "d400": (141, 400)}
    count = lambda by, low, high: f"count(*) over (partition by {by} order by doc_id range between {low} following and {high} following)"
    columns = ", ".join(f"{count('source', a, b)} as p{name}, {count('source, lang', a, b)} as s{name}" for name, (a, b) in bands.items())
    columns += f", {count('source', 401, 'unbounded')} as pfar, {count('source, lang', 401, 'unbounded')} as sfar"
    rows = " union all ".join(f"select '{name}' as band, cast(sum(p{name}) as bigint) as pairs, sum(s{name}) * 1.0e0 as same from c" for name in (*bands, "far"))
    return f"with c as (select {columns} from {{documents}}) select band, pairs, round(same / pairs, 6) as same_lang from ({rows}) r where pairs > 0"


@plan("ty")
def letter_jsd(d: Spark) -> str:
    """Jensen-Shannon divergence of letters between languages: two histograms in full outer alignment."""
    letters = f"select lang, sym, sum(n) * 1.0e0 / sum(sum(n)) over (partition by lang) as p from (select lang, n, substr(tok, cast(i as int), 1) as sym from (select lang, tok, n, cast(length(tok) as bigint) as m from {{ty}}) q {d.each('1', 'm', 'i')}) z group by lang, sym"
    return f"""with f as ({letters}) select la, lb, round(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0.0e0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0.0e0 end) / 2, 6) as jsd from (
        select la, lb, sym, max(p) as p, max(q) as q from (select x.lang as la, y.lang as lb, x.sym, x.p, 0.0e0 as q from f x join (select distinct lang from f) y on x.lang < y.lang union all select x.lang, y.lang, y.sym, 0.0e0, y.p from f y join (select distinct lang from f) x on x.lang < y.lang) u group by la, lb, sym) v group by la, lb"""


@plan("documents", "labels")
def labelled_pages(d: Spark) -> str:
    """Pages with labels, and those without."""
    return "select x.lang, count(*) as pages, count(l.doc_id) as labelled, round(avg(l.quality * 1.0e0), 6) as quality from {documents} x left join {labels} l on x.doc_id = l.doc_id group by x.lang"


@plan("benchmark", "tk")
def six_word_chunks(d: Spark) -> str:
    """Chunks of six words of the benchmark that no page holds."""
    words = d.find_all("lower(text)", r"[\p{{L}}\p{{Nl}}\p{{No}}]+")
    own = f"select item_id, cast(floor(pos / 6) as bigint) as k, {d.joined('tok', 'pos')} as chunk, count(*) as n from (select item_id, {words} as words from {{benchmark}}) q {d.numbered('words', 'pos', 'tok')} group by item_id, cast(floor(pos / 6) as bigint)"
    grams = "select distinct concat(tok, ' ', n1, ' ', n2, ' ', n3, ' ', n4, ' ', n5) as chunk from (select tok, " + ", ".join(f"lead(tok, {k}) over (partition by doc_id order by line_no, pos) as n{k}" for k in range(1, 6)) + " from {tk}) g where n5 is not null"
    return f"select count(*) as chunks, sum(case when g.chunk is null then 1 else 0 end) * 1.0e0 as missing from ({own}) c left join ({grams}) g on c.chunk = g.chunk where c.n = 6"


@plan("tk")
def edge_sets(d: Spark) -> str:
    """Types of two languages: met in both, in one only."""
    return "select x.lang as la, y.lang as lb, count(*) as both_ from (select distinct lang, tok from {tk}) x join (select distinct lang, tok from {tk}) y on x.tok = y.tok and x.lang < y.lang group by x.lang, y.lang"
