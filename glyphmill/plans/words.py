"""Statistics of words and characters."""

from __future__ import annotations

from glyphmill.functions.dialect import Spark
from glyphmill.plans import plan


@plan("tk")
def token_stats(d: Spark) -> str:
    """Tokens, types, hapaxes, mean length and word entropy of each language."""
    return """select lang, cast(sum(n) as bigint) as tokens, count(*) as types, round(count(*) * 1.0e0 / sum(n), 6) as ttr,
        round(sum(case when n = 1 then 1 else 0 end) * 1.0e0 / count(*), 6) as hapax, round(sum(n * len) * 1.0e0 / sum(n), 6) as word_length,
        round(-sum(n * 1.0e0 / total * log2(n * 1.0e0 / total)), 6) as entropy
        from (select lang, tok, length(tok) as len, count(*) as n, sum(count(*)) over (partition by lang) as total from {tk} group by lang, tok) q group by lang"""


@plan("ty")
def top_words(d: Spark) -> str:
    """The 15 most frequent words of each language; ties by word."""
    return "select lang, tok, n, cast(r as bigint) as r from (select lang, tok, n, row_number() over (partition by lang order by n desc, tok) as r from {ty}) q where r <= 15"


@plan("tk")
def length_histogram(d: Spark) -> str:
    return "select lang, cast(length(tok) as bigint) as len, count(*) as n, count(distinct tok) as types from {tk} group by lang, length(tok)"


@plan("ty")
def zipf_slope(d: Spark) -> str:
    """Slope of log frequency on log rank over the 200 most frequent words."""
    return "select lang, round(regr_slope(ln(n * 1.0e0), ln(r * 1.0e0)), 6) as slope from (select lang, n, row_number() over (partition by lang order by n desc, tok) as r from {ty}) q where r <= 200 group by lang"


@plan("lineitem")
def zipf_parts(d: Spark) -> str:
    """The same slope for any key: parts of line items."""
    return "select round(regr_slope(ln(n * 1.0e0), ln(r * 1.0e0)), 6) as slope from (select n, row_number() over (order by n desc, l_partkey) as r from (select l_partkey, count(*) as n from {lineitem} group by l_partkey) p) q where r <= 200"


def _stream(d: Spark) -> str:
    """Counts of neighbouring characters in the words of a language joined by blanks in order."""
    return f"""select lang, a, b, cast(sum(c) as bigint) as c from (
        select lang, substr(tok, cast(i as int), 1) as a, substr(tok, cast(i as int) + 1, 1) as b, sum(n) as c from (select lang, tok, n, cast(length(tok) as bigint) - 1 as m from {{ty}}) q {d.each('1', 'm', 'i')} group by lang, tok, i
        union all select lang, right(tok, 1) as a, ' ' as b, count(*) as c from (select lang, tok, lead(tok) over (partition by lang, doc_id order by line_no, pos) as nxt from {{tk}}) q where nxt is not null group by lang, right(tok, 1)
        union all select lang, ' ' as a, left(nxt, 1) as b, count(*) as c from (select lang, lead(tok) over (partition by lang, doc_id order by line_no, pos) as nxt from {{tk}}) q where nxt is not null group by lang, left(nxt, 1)) z group by lang, a, b"""


@plan("tk", "ty")
def char_entropy(d: Spark) -> str:
    """Entropies of characters: of their number, of one, and of one given the one before, in words joined by blanks, page by page."""
    return f"""select lang, count(distinct a) as alphabet, round(log2(count(distinct a) * 1.0e0), 6) as h0, round(max(h1), 6) as h1, round(-sum(c * 1.0e0 / n * log2(c * 1.0e0 / n)) - max(h1), 6) as h2
        from (select z.*, -sum(c * 1.0e0 / n * log2(ca * 1.0e0 / n)) over (partition by lang) as h1 from (
          select lang, a, b, c, sum(c) over (partition by lang, a) as ca, sum(c) over (partition by lang) as n from ({_stream(d)}) s) z) y group by lang"""


def _conditional(d: Spark, k: int) -> str:
    return f"""select lang, {k} as k, round(-sum(c * 1.0e0 / n * log2(c * 1.0e0 / cx)), 6) as h from (
        select lang, ctx, sym, c, sum(c) over (partition by lang, ctx) as cx, sum(c) over (partition by lang) as n from (
          select lang, substr(t, cast(i as int), {k}) as ctx, substr(t, cast(i as int) + {k}, 1) as sym, cast(sum(n) as bigint) as c
          from (select lang, n, concat(repeat('^', {k}), tok, '$') as t, cast(length(tok) as bigint) + 1 as m from {{ty}}) q {d.each('1', 'm', 'i')} group by 1, 2, 3) z) y group by lang"""


@plan("ty")
def conditional_entropy(d: Spark) -> str:
    """Bits of a letter given the 1 to 4 before it, within words with marked ends."""
    return " union all ".join(_conditional(d, k) for k in (1, 2, 3, 4))


@plan("ty")
def positional_letters(d: Spark) -> str:
    """How often each letter stands first, last and inside words."""
    return f"""select lang, sym, cast(sum(n) as bigint) as n, round(sum(case when i = 1 then n else 0 end) * 1.0e0 / sum(n), 6) as first_share,
        round(sum(case when i = m then n else 0 end) * 1.0e0 / sum(n), 6) as last_share, round(sum(case when i > 1 and i < m then n else 0 end) * 1.0e0 / sum(n), 6) as inner_share
        from (select lang, n, i, m, substr(tok, cast(i as int), 1) as sym from (select lang, tok, n, cast(length(tok) as bigint) as m from {{ty}}) q {d.each('1', 'm', 'i')}) z group by lang, sym"""


@plan("tk")
def line_position_letters(d: Spark) -> str:
    """First letters of words that begin, end and stand inside lines."""
    return """select lang, left(tok, 1) as sym, round(avg(case when pos = 0 then 1.0e0 else 0.0e0 end), 6) as at_start, round(avg(case when pos = n_line - 1 then 1.0e0 else 0.0e0 end), 6) as at_end, count(*) as n
        from {tk} group by lang, left(tok, 1) having count(*) >= 20"""


@plan("ty")
def letter_transitions(d: Spark) -> str:
    """Shares of the 20 most frequent letter pairs of each language among pairs with the same first letter."""
    return f"""select lang, a, b, c, round(c * 1.0e0 / ca, 6) as share from (select *, row_number() over (partition by lang order by c desc, a, b) as r from (
        select lang, a, b, c, sum(c) over (partition by lang, a) as ca from (
          select lang, substr(tok, cast(i as int), 1) as a, substr(tok, cast(i as int) + 1, 1) as b, cast(sum(n) as bigint) as c from (select lang, tok, n, cast(length(tok) as bigint) - 1 as m from {{ty}}) q {d.each('1', 'm', 'i')} group by 1, 2, 3) z) y) x where r <= 20"""


@plan("ty")
def position_entropy(d: Spark) -> str:
    """Entropy of the letter at each of three places from either end, over that of all letters."""
    parts = " union all ".join([f"select lang, 's{k}' as place, substr(tok, {k}, 1) as sym, n from {{ty}} where length(tok) >= {k}" for k in (1, 2, 3)] + [f"select lang, 'e{k}' as place, substr(tok, length(tok) - {k - 1}, 1) as sym, n from {{ty}} where length(tok) >= {k}" for k in (1, 2, 3)] + [f"select lang, 'all' as place, substr(tok, cast(i as int), 1) as sym, n from (select lang, tok, n, cast(length(tok) as bigint) as m from {{ty}}) q {d.each('1', 'm', 'i')}"])
    return f"""select lang, place, round(h, 6) as h, round(h / max(case when place = 'all' then h end) over (partition by lang), 6) as over_all from (
        select lang, place, -sum(c * 1.0e0 / n * log2(c * 1.0e0 / n)) as h from (
          select lang, place, sym, sum(n) as c, sum(sum(n)) over (partition by lang, place) as n from ({parts}) p group by lang, place, sym) z group by lang, place) y"""


@plan("ty")
def slot_grammar(d: Spark) -> str:
    """Share of types and tokens that a pattern of slots covers: up to three consonants, vowels, consonants, vowels, consonants."""
    hit = d.matches("tok", "[bcdfghjklmnpqrstvwxyz]{{0,3}}[aeiou]{{1,2}}[bcdfghjklmnpqrstvwxyz]{{0,3}}([aeiou]{{1,2}}[bcdfghjklmnpqrstvwxyz]{{0,3}})?")
    return f"select lang, round(avg(case when {hit} then 1.0e0 else 0.0e0 end), 6) as types, round(sum(case when {hit} then n else 0 end) * 1.0e0 / sum(n), 6) as tokens from {{ty}} group by lang"


@plan("tk")
def immediate_repeats(d: Spark) -> str:
    """Words of more than two letters that stand twice, and three times, in a row."""
    return """select lang, sum(case when tok = n1 and length(tok) > 2 then 1 else 0 end) * 1.0e0 as pairs, sum(case when tok = n1 and tok = n2 then 1 else 0 end) * 1.0e0 as triples, count(*) as tokens
        from (select lang, tok, lead(tok) over (partition by doc_id, line_no order by pos) as n1, lead(tok, 2) over (partition by doc_id, line_no order by pos) as n2 from {tk}) q group by lang"""


@plan("tk")
def features_by_place(d: Spark) -> str:
    """Shares of ten features of words by where they stand in their line."""
    place = "case when n_line = 1 then 'only' when pos = 0 then 'first' when pos = 1 then 'second' when pos = n_line - 1 then 'last' when pos = n_line - 2 then 'penult' else 'middle' end"
    vowels = "length(tok) - length(translate(tok, 'aeiou', ''))"
    features = {
        "starts_vowel": "left(tok, 1) in ('a','e','i','o','u')", "ends_vowel": "right(tok, 1) in ('a','e','i','o','u')", "single": "length(tok) = 1", "long": "length(tok) >= 7", "starts_s": "left(tok, 1) = 's'",
        "ends_s": "right(tok, 1) = 's'", "ends_n": "right(tok, 1) = 'n'", "has_th": "tok like '%th%'", "vowels3": f"{vowels} >= 3", "no_vowel": f"{vowels} = 0",
    }
    shares = ", ".join(f"round(avg(case when {test} then 1.0e0 else 0.0e0 end), 6) as {name}" for name, test in features.items())
    return f"select lang, {place} as place, count(*) as n, round(avg(length(tok) * 1.0e0), 6) as len, {shares} from {{tk}} group by lang, {place}"


@plan("ty")
def frequency_bands(d: Spark) -> str:
    """Types and tokens by band: once, rare 2-4, medium 5-19, frequent 20-99, very frequent from 100."""
    band = "case when n = 1 then 'H' when n < 5 then 'R' when n < 20 then 'M' when n < 100 then 'F' else 'VF' end"
    return f"select lang, {band} as band, count(*) as types, cast(sum(n) as bigint) as tokens from {{ty}} group by lang, {band}"


@plan("tk", "ty")
def reduced_vocabulary(d: Spark) -> str:
    """Tokens of each of the 100 most frequent words of a language, and of all others as #."""
    return """select t.lang, coalesce(w.tok, '#') as tok, count(*) as n from {tk} t left join (select lang, tok from (select lang, tok, row_number() over (partition by lang order by n desc, tok) as r from {ty}) q where r <= 100) w
        on t.lang = w.lang and t.tok = w.tok group by t.lang, coalesce(w.tok, '#')"""


@plan("documents")
def share_of_labels(d: Spark) -> str:
    """Shares of pages by language and source with all subtotals."""
    return "select lang, source, count(*) as n, round(avg(n_chars * 1.0e0), 6) as chars from {documents} group by grouping sets ((lang, source), (lang), ())"


@plan("talk")
def talk_stats(d: Spark) -> str:
    """Word statistics of conversations by role."""
    return "select role, count(*) as tokens, count(distinct tok) as types, round(avg(length(tok) * 1.0e0), 6) as word_length, count(distinct conv_id) as pages from {talk} group by role"


@plan("markup")
def page_words(d: Spark) -> str:
    """Words of each web page once its markup is gone."""
    return "select page_id, count(*) as tokens, count(distinct tok) as types from {markup} group by page_id"


@plan("acts")
def event_stats(d: Spark) -> str:
    """Event types as words: counts, neighbours of the same type, mean of a property."""
    return "select tok, count(*) as n, sum(case when tok = nxt then 1 else 0 end) * 1.0e0 as repeats, round(avg(k * 1.0e0), 6) as mean_k from (select tok, k, lead(tok) over (partition by user_id order by idx) as nxt from {acts}) q group by tok"
