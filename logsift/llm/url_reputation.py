"""URL filter: fixed rules first, then empirical-Bayes reputation of the host.

Rules (host, path) fit their host and all its subdomains where the path of the
url starts with the rule's; the longest fitting rule (host and path together)
decides.  Pages that a rule decides are also the labelled outcomes (1: blocked)
from which the reputation of hosts is learnt; other outcomes can be passed in.

Reputation is a chain of beta-binomial priors.  The share of blocked pages of
all outcomes, with ``strength`` pseudo-pages, is the prior of a suffix; the
suffix's posterior mean, with as many pseudo-pages, is the prior of a
registered domain, and that one's the prior of a host.  A page without a rule
is blocked if the posterior probability of being blocked is high for sure: if
the lower bound (mean less ``z`` standard deviations of the beta posterior) of
its host is over ``cut``.  A host without outcomes is judged by its domain's posterior, a
domain without any by its suffix's, and a suffix without any by all outcomes.

Everything is a DataFrame expression; counts are aggregated by host before
they move, so a host that holds a third of all pages is one row of each task.
Hosts join back by name; AQE splits that join where it is skewed.

Cases: null urls and urls without ``://`` have an empty host and path, fit no
rule and are judged by all outcomes; hosts keep ports and user parts as they
are; repeated pages each count and are each returned; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRENGTH = 10.0
CUT = 0.5
Z = 1.0
#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path)."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = urls.select("page_id", F.expr(
        "CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END").alias("rest"))
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    return parts.select("page_id", F.translate(host, UPPER, LOWER).alias("host"),
                        F.regexp_extract("rest", r"^[^/?#]*(/[^?#]*)", 1).alias("path"))


def rule_columns(rules=RULES):
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def levels(df: DataFrame) -> DataFrame:
    """Adds the registered domain (last two labels) and the suffix (last label) of ``host``."""
    labels = F.split("host", r"\.")
    return df.withColumns({"domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
                           "suffix": F.element_at(labels, -1)})


def shrink(bad, n, prior):
    return (bad + STRENGTH * prior) / (n + STRENGTH)


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Posterior (mean, pages) tables by ``host``, ``domain``, ``suffix`` and over all (one row), from (host, bad, n)."""
    hosts = levels(outcomes.groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.sum("n").cast("double").alias("n")))
    every = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).select(
        shrink(F.col("bad"), F.col("n"), 0.5).alias("all_mean"), F.col("n").alias("all_n"))
    suffix = hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).select(
        "suffix", shrink(F.col("bad"), F.col("n"), every.select("all_mean").scalar()).alias("suffix_mean"),
        F.col("n").alias("suffix_n"))
    domain = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).join(suffix, "suffix").select(
        "domain", shrink(F.col("bad"), F.col("n"), F.col("suffix_mean")).alias("domain_mean"), F.col("n").alias("domain_n"))
    host = hosts.join(domain, "domain").select(
        "host", shrink(F.col("bad"), F.col("n"), F.col("domain_mean")).alias("host_mean"), F.col("n").alias("host_n"))
    return {"host": host, "domain": domain, "suffix": suffix, "all": every}


def bound(mean, n):
    """Lower posterior bound of the share of blocked pages: beta with mean and ``n + strength`` pseudo-pages."""
    return mean - Z * F.sqrt(mean * (1 - mean) / (n + STRENGTH + 1))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               outcomes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, reputation_bound) for every page.

    ``outcomes``: (host, bad, n) labelled pages; by default the pages that a rule decides.
    """
    rule, verdict = rule_columns(rules)
    ruled = split_url(pages, id_col, url_col).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    if outcomes is None:
        outcomes = ruled.where(F.col("rule").isNotNull()).groupBy("host").agg(
            F.sum((F.col("said") == "block").cast("int")).alias("bad"), F.count(F.lit(1)).alias("n"))
    known = reputation(outcomes)
    # judged once for each host; hosts are far fewer than pages
    hosts = levels(ruled.select("host").distinct()).join(known["host"], "host", "left").join(
        known["domain"], "domain", "left").join(known["suffix"], "suffix", "left").select(
        "host", F.coalesce("host_mean", "domain_mean", "suffix_mean", known["all"].select("all_mean").scalar()).alias("mean"),
        F.coalesce("host_n", "domain_n", "suffix_n", known["all"].select("all_n").scalar()).alias("n"))
    judged = ruled.join(hosts, "host")
    low = bound(F.col("mean"), F.col("n"))
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce("said", F.when(low > CUT, "block").otherwise("allow")).alias("verdict"),
                         F.col("mean").alias("reputation"), low.alias("reputation_bound"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u),
h AS (
  SELECT host, list_reverse(string_split(host, '.'))[1] AS suffix,
         CASE WHEN strpos(host, '.') > 0
              THEN list_reverse(string_split(host, '.'))[2] || '.' || list_reverse(string_split(host, '.'))[1] ELSE host END AS domain,
         count(rule) AS n,
         count(*) FILTER (WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS bad
  FROM r GROUP BY host),
a AS (SELECT (coalesce(sum(bad), 0) + 10 * 0.5) / (coalesce(sum(n), 0) + 10.0) AS m, coalesce(sum(n), 0) AS n FROM h),
s AS (SELECT suffix, (sum(h.bad) + 10 * any_value(a.m)) / (sum(h.n) + 10.0) AS m, sum(h.n) AS n
      FROM h CROSS JOIN a WHERE h.n > 0 GROUP BY suffix),
d AS (SELECT domain, (sum(h.bad) + 10 * any_value(s.m)) / (sum(h.n) + 10.0) AS m, sum(h.n) AS n
      FROM h JOIN s USING (suffix) WHERE h.n > 0 GROUP BY domain),
j AS (
  SELECT h.host,
         CASE WHEN h.n > 0 THEN (h.bad + 10 * d.m) / (h.n + 10.0) ELSE coalesce(d.m, s.m, a.m) END AS m,
         CASE WHEN h.n > 0 THEN h.n ELSE coalesce(d.n, s.n, a.n) END AS n
  FROM h LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix) CROSS JOIN a)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN m - 1.0 * sqrt(m * (1 - m) / (n + 11)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN j USING (host)
"""
