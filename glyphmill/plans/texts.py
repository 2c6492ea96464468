"""Rewriting and cutting words."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan


@plan("types")
def multigraph_units(d: Spark) -> str:
    """Words as units: some letter groups count as one, longest first."""
    return f"select unit, cast(sum(n) as bigint) as n, count(*) as places from (select n, {d.find_all('tok', 'tion|ing|the|th|sh|ch|er|ou|.')} as units from {{types}}) q {d.items('units', 'unit')} group by unit"


@plan("types")
def retokenised(d: Spark) -> str:
    """Letter groups replaced by single signs, the longer first; then types and mean length."""
    t = "tok"
    for group, sign in (("tion", "1"), ("ing", "2"), ("th", "3"), ("er", "4"), ("ou", "5"), ("sh", "6")):
        t = f"replace({t}, '{group}', '{sign}')"
    return f"select count(distinct t) as types, round(sum(n * length(t)) * 1.0e0 / sum(n), 6) as unit_length from (select {t} as t, n from {{types}}) q"


@plan("types")
def families(d: Spark) -> str:
    """Types left when variants fall together, lightly and heavily."""
    light = d.replace_all(d.replace_all("tok", "ee+", "e"), "oo+", "o")
    heavy = d.replace_all(d.replace_all(light, "th|sh|ch", "h"), "[aeiou]+", "a")
    return f"select count(*) as types, count(distinct {light}) as light, count(distinct {heavy}) as heavy, count(distinct left(tok, 4)) as stems from {{types}}"


@plan("types")
def consonant_skeletons(d: Spark) -> str:
    """Words without their vowels; the most frequent skeletons."""
    return "select skeleton, count(*) as types, cast(sum(n) as bigint) as n from (select translate(tok, 'aeiou', '') as skeleton, n from {types}) q where skeleton <> '' group by skeleton having count(*) > 1"


@plan("types")
def syllables(d: Spark) -> str:
    """Words cut before a consonant that a vowel follows, but for the first."""
    marked = d.replace_all("tok", "([bcdfghjklmnpqrstvwxyz][aeiouy])", f"|{d.group(1)}")
    first_off = d.replace_all(marked, "^([^|]*)[|]", d.group(1))
    return f"select syllable, cast(sum(n) as bigint) as n, count(*) as places from (select n, {d.split(first_off, '[|]')} as parts from {{types}}) q {d.items('parts', 'syllable')} where syllable <> '' group by syllable"


@plan("tp")
def regrouped(d: Spark) -> str:
    """Pages' words in groups of three, and how often a group recurs."""
    return f"select count(*) as groups, count(distinct g) as types from (select doc_id, cast(floor(idx / 3) as bigint) as k, {d.joined('tok', 'idx')} as g from {{tp}} group by doc_id, cast(floor(idx / 3) as bigint)) q"


@plan("ty")
def fixed_chunks(d: Spark) -> str:
    """Words cut in pieces of three letters."""
    return f"select lang, piece, cast(sum(n) as bigint) as n from (select lang, n, substr(tok, cast(i as int) * 3 + 1, 3) as piece from (select lang, tok, n, cast(floor((length(tok) - 1) / 3) as bigint) as m from {{ty}}) q {d.each('0', 'm', 'i')}) z group by lang, piece having sum(n) >= 5"


@plan("types")
def rule_spaces(d: Spark) -> str:
    """Words cut behind certain letters once a piece has two letters or more."""
    return f"select piece, cast(sum(n) as bigint) as n from (select n, {d.find_all('tok', '.+?.[dnsty]|.+')} as pieces from {{types}}) q {d.items('pieces', 'piece')} group by piece"


@plan("types")
def plain_alphabet(d: Spark) -> str:
    """Texts brought to a smaller alphabet: w as uu, j as i, k as c."""
    t = d.replace_all("replace(translate(tok, 'jk', 'ic'), 'w', 'uu')", "[^a-z]", "")
    return f"select count(*) as types, count(distinct {t}) as mapped, cast(sum(n * length({t})) as bigint) as letters from {{types}}"


@plan("types")
def tall_letters(d: Spark) -> str:
    """The first tall letter of words, with what may stand around it."""
    g = d.extract("tok", "c?[tklbd]h?", 0)
    return f"select case when {g} = '' then '-' else {g} end as tall, count(*) as types, cast(sum(n) as bigint) as n from {{types}} group by 1"


@plan("ed1")
def edit_kinds(d: Spark) -> str:
    """Pairs at distance 1 by kind of edit, the letters, and where in the word."""
    return """select kind, x, y, place, count(*) as n from (select case when length(a) = length(b) then 'sub' when length(a) < length(b) then 'ins' else 'del' end as kind,
          case when length(a) < length(b) then '' else substr(a, cast(k as int) + 1, 1) end as x, case when length(a) > length(b) then '' else substr(b, cast(k as int) + 1, 1) end as y,
          case when k = 0 then 'start' when k + 1 >= greatest(length(a), length(b)) then 'end' else 'mid' end as place from {ed1}) z group by kind, x, y, place"""


@plan("ed1")
def edit_direction(d: Spark) -> str:
    """Of substitutions and their inverses, met 20 times together, how far the order of the words in the alphabet favours one: z."""
    return """select x, y, n, m, round((n - m) / sqrt((n + m) * 1.0e0), 6) as z from (select x, y, sum(case when a < b then 1 else 0 end) * 1.0e0 as n, sum(case when a > b then 1 else 0 end) * 1.0e0 as m from (
          select a, b, substr(a, cast(k as int) + 1, 1) as x, substr(b, cast(k as int) + 1, 1) as y from {ed1} where length(a) = length(b)) z group by x, y) w where n + m >= 20"""


@plan("types")
def common_suffixes(d: Spark) -> str:
    """Longest ending that a word shares with the one after it in the alphabet."""
    return f"select s, count(*) as n from (select a, max(case when k > 0 and right(a, cast(k as int)) = right(b, cast(k as int)) then k else 0 end) as s from (select a, b, least(length(a), length(b)) as m from (select tok as a, lead(tok) over (partition by left(tok, 1) order by tok) as b from {{types}}) q where b is not null) y {d.each('0', 'm', 'k')} group by a) z group by s"


@plan("tk")
def place_strata(d: Spark) -> str:
    """Tokens by their distance from either end of the line, up to two."""
    return "select lang, least(pos, 2) as from_start, least(n_line - 1 - pos, 2) as from_end, count(*) as n from {tk} group by lang, least(pos, 2), least(n_line - 1 - pos, 2)"


@plan("documents")
def sentences(d: Spark) -> str:
    """Sentences of six words and more by language."""
    word = r"[\p{{L}}\p{{Nl}}\p{{No}}]+"
    return f"select lang, count(*) as sentences, cast(sum(n) as bigint) as words from (select lang, cast({d.size(d.find_all('lower(s)', word))} as bigint) as n from (select lang, s from {{documents}} {d.items(d.split('text', '[.;:?!]'), 's')}) q) z where n >= 6 group by lang"


@plan("ln")
def line_flags(d: Spark) -> str:
    """Lines by whether they end a paragraph, are hyphenated and hold words."""
    return f"""select lang, count(*) as lines, sum(case when nxt is null or nxt = '' then 1 else 0 end) * 1.0e0 as para_final, sum(case when right(line, 1) = '-' then 1 else 0 end) * 1.0e0 as hyphenated, sum(case when {d.size('words')} >= 2 then 1 else 0 end) * 1.0e0 as usable
        from (select *, lead(line) over (partition by doc_id order by line_no) as nxt from {{ln}}) q group by lang"""


@plan("ln")
def paragraphs(d: Spark) -> str:
    """Lines with words by their paragraph's running number in the page, which lines without words begin anew: paragraphs, and their lines."""
    running = f"select *, sum(case when {d.size('words')} = 0 then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as para from {{ln}}"
    return f"select lang, count(*) as paragraphs, cast(max(n) as bigint) as most_lines, round(avg(n * 1.0e0), 6) as mean_lines from (select lang, doc_id, para, count(*) as n from ({running}) r where {d.size('words')} > 0 group by lang, doc_id, para) q group by lang"


@plan("types")
def random_chunks(d: Spark) -> str:
    """Words cut behind each letter with a chance of a third, by a hash of word and place: pieces of random lengths."""
    letters = f"select tok, n, i, m, substr(tok, cast(i as int), 1) as sym, case when {d.u("concat('rc', tok, ':', cast(i as string))")} < 0.3333e0 then 1 else 0 end as cut from (select tok, n, cast(length(tok) as bigint) as m from {{types}}) q {d.each('1', 'm', 'i')}"
    numbered = f"select *, sum(cut) over (partition by tok order by i rows between unbounded preceding and current row) - cut as k from ({letters}) l"
    return f"select length(piece) as len, count(distinct piece) as pieces, cast(sum(n) as bigint) as n from (select {d.joined('sym', 'i', '')} as piece, max(n) as n from ({numbered}) z group by tok, k) y group by length(piece)"


@plan("tp")
def random_lines(d: Spark) -> str:
    """Pages' words in lines of random lengths: a line ends behind a word with a chance of an eighth, by a hash of its place."""
    ends = f"select lang, doc_id, idx, case when {d.u("concat('rl', cast(doc_id as string), ':', cast(idx as string))")} < 0.125e0 then 1 else 0 end as cut from {{tp}}"
    numbered = f"select *, sum(cut) over (partition by doc_id order by idx rows between unbounded preceding and current row) - cut as k from ({ends}) e"
    return f"select lang, count(*) as lines, cast(max(n) as bigint) as most, round(avg(n * 1.0e0), 6) as mean_words from (select lang, doc_id, k, count(*) as n from ({numbered}) z group by lang, doc_id, k) y group by lang"


@plan("documents")
def sentence_lines(d: Spark) -> str:
    """Each sentence of a page as a line of its own: lines, and their words."""
    parts = f"select lang, doc_id, at_, {d.find_all('lower(part)', r'[\p{{L}}\p{{Nl}}\p{{No}}]+')} as words from (select lang, doc_id, {d.split('text', '[.!?]')} as parts from {{documents}}) q {d.numbered('parts', 'at_', 'part')}"
    return f"select lang, count(*) as lines, cast(sum({d.size('words')}) as bigint) as words, cast(max({d.size('words')}) as bigint) as most from ({parts}) p where {d.size('words')} > 0 group by lang"


@plan("embeddings")
def angles(d: Spark) -> str:
    """Mean direction of vectors in the plane of their first two components, in degrees, by label."""
    x, y = (f"cast({d.item('embedding', str(k))} as double)" for k in (1, 2))
    return f"select label, count(*) as n, round(degrees(atan2(sum(sin(a)), sum(cos(a)))), 6) as direction from (select label, atan2({y}, {x}) as a from {{embeddings}}) q where a is not null group by label"


@plan("pages")
def url_parts(d: Spark) -> str:
    """Pages by scheme and last label of their host."""
    return f"select {d.extract('url', '^([a-z]+)://', 1)} as scheme, {d.extract('url', '://[^/?#]*[.]([a-z]+)', 1)} as top, count(*) as n from {{pages}} group by 1, 2"
