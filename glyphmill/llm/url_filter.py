"""URL verdicts from rules and from the links between hosts. DataFrame operations only.

Rules name a host, whose subdomains they cover, and a path prefix; the longest that fits decides. Pages without a rule
follow their host: trust flows from pages that rules allow along links (personalised PageRank), distrust from pages
that they block against the links, to hosts that link there. A host with more distrust than trust is blocked. Hosts
are tied by the links of their pages (absolute ones and those with a host alone; a <base> of another host counts as a
link there, other links stay on their host), and by their names: a host and the domain above it, down to two labels,
link to each other, as those who run a domain answer for its hosts. Domains under which anyone can have a host tie
strangers; for such corpora turn that off.

Amounts are doubles in millionths of a page, as a share of a share may be of any size and none may be cut. Only what
comes out is rounded, to DIGITS significant digits: sums in another order differ far behind these, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.scratch import cut

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ROUNDS, DAMPING = 20, 0.85
UNIT = 1_000_000
#: Significant digits of the amounts that verdicts are made of.
DIGITS = 9
#: Share of distrust in a host's evidence above which it is blocked.
DISTRUST = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, _, rest = rule.partition("/")
    return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as {rule, verdict}; null if none does. Of equally long ones a block comes first."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(_fits(rule, host, path), value) if out is None else out.when(_fits(rule, host, path), value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many pages' links lead from a host to another. pages: (host, html)."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    links = links.select("src", F.translate(F.regexp_replace("dst", r"(^[^@]*@)|(:\d*$)", ""), _UPPER, _LOWER).alias("dst"))
    return links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): a host and the domain above it, both ways, up to domains of two labels; none for numeric addresses. hosts: (host)."""
    labels = F.split("host", r"\.")
    names = hosts.where(~F.col("host").rlike(r"^[\d.:]*$|\[")).select(F.expr("transform(sequence(1, greatest(size(split(host, '[.]')) - 1, 1)), k -> array_join(slice(split(host, '[.]'), k, 1000), '.'))").alias("names"), F.size(labels).alias("n")).where("n > 2")
    pairs = names.select(F.explode(F.expr("transform(sequence(1, size(names) - 1), k -> struct(names[k - 1] as a, names[k] as b))")).alias("p")).select("p.a", "p.b").distinct()
    weight = F.lit(1).cast("bigint").alias("weight")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight).union(pairs.select("b", "a", weight))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, amount): seeds (host, amount) after personalised PageRank along links (src, dst, weight).

    What reaches a host without links stays there once and is not dealt out again. Seeds and links may be empty. A
    host's links are summed before they are dealt, and shares before they are shuffled, so a hub isn't one task's work.
    """
    outgoing = links.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = cut(links.join(outgoing, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    base = cut(seeds.where("amount > 0").select("host", F.col("amount").cast("double").alias("amount")), "seeds")
    now = base
    if not shares.isEmpty() and not base.isEmpty():
        for k in range(rounds):
            flow = shares.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("amount") * F.col("share") * damping).alias("amount"))
            kept = base.select("host", (F.col("amount") * (1 - damping)).alias("amount"))
            now = flow.union(kept).groupBy("host").agg(F.sum("amount").alias("amount"))
            if k % 4 == 3:
                now = cut(now, "amounts")
    return now


def _rounded(amount: Column) -> Column:
    return F.format_string(f"%.{DIGITS - 1}e", amount).cast("double")


def judge_hosts(parsed: DataFrame, distrust_share: float = DISTRUST, domains: bool = True) -> DataFrame:
    """(host, trust, distrust, verdict) of every host of parsed pages (host, path, html, r)."""
    counted = cut(parsed.groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").alias("allowed"), F.count_if(F.col("r.verdict") == "block").alias("blocked")), "hosts")
    links = host_links(parsed)
    if domains:
        links = links.union(domain_links(counted)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    links = cut(links, "links")
    trust = propagate(links, counted.select("host", (F.col("allowed") * UNIT).alias("amount")))
    distrust = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), counted.select("host", (F.col("blocked") * UNIT).alias("amount")))
    trust = trust.select(F.col("host").alias("th"), _rounded(F.col("amount")).alias("trust"))
    distrust = distrust.select(F.col("host").alias("dh"), _rounded(F.col("amount")).alias("distrust"))
    both = counted.join(trust, F.col("host") == F.col("th"), "left").join(distrust, F.col("host") == F.col("dh"), "left")
    zero = F.lit(0.0)
    both = both.select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    bad = F.col("distrust") > (F.col("trust") + F.col("distrust")) * distrust_share
    return both.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, domains: bool = True) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row of pages.

    A null url, or one without ://, has an empty host and path, fits no rule and, as a host without evidence, is
    allowed. Null html has no links. Repeated rows count each. No pages give no rows. Other columns are not read.
    """
    own = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("html"))
    parsed = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    hosts = cut(judge_hosts(parsed, domains=domains), "judged").select(F.col("host").alias("h"), F.col("verdict").alias("method"), "trust", "distrust")
    judged = parsed.drop("html").join(hosts, F.col("host") == F.col("h"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "method").alias("verdict"), "trust", "distrust")


def op4(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
