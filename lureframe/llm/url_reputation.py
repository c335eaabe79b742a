"""URL filter: empirical-Bayes host reputation.

Labelled page outcomes are counted per host.  Each level (suffix, registered
domain, host) has a beta-binomial prior around the posterior of the level above;
the prior's weight is estimated from how far the groups of that level scatter.
A host is blocked when the lower posterior bound of its bad rate is too high.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..lexicon import MULTI_SUFFIXES
from .common import stored

#: (host/path, verdict): fits the host and its subdomains where the path starts with the rule's.
Rule = tuple[str, str]
#: z of a one-sided 95 % bound, and the bad rate above which a host is blocked.
Z, BAD_RATE = 1.645, 0.5
#: Prior weights, in pseudo-outcomes, are kept in this range.
WEIGHT_MIN, WEIGHT_MAX = 1.0, 1000.0
#: A rule list becomes one expression; longer lists belong in a joined table.
MAX_RULES = 2000


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; null or no '://': empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user-info and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where they are a known suffix; 'ip' for an address."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), "ip").when(two.isin(MULTI_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label before it; an address is its own domain."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(MULTI_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one asked is the first that counts
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_outcomes(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """host, domain, suffix, n, bad of every host of ``pages``; ``outcomes``: (page_id, bad 0/1/null), several per page all count."""
    seen = pages.select(F.col(page_id).alias("_page"), host_of(F.col(url)).alias("host"))
    told = outcomes.select(F.col("page_id").alias("_page"), F.col("bad").cast("long").alias("bad")).where("bad is not null")
    # counted per page and per host before they meet, so that a hot host never stands in one task
    per_page = told.groupBy("_page").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = seen.join(per_page, "_page", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    return hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")


def prior_weight(groups: DataFrame, parent: str) -> float:
    """Pseudo-outcomes of the prior of one level: moments of the scatter of labelled groups around their parent's rate."""
    told = groups.where("n > 0")
    up = told.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.count(F.lit(1)).alias("k"),
                                  F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2"))
    p = F.col("pb") / F.col("pn")
    # sum of n (rate - p)^2 = sum of b^2/n - p^2 N; only parents with two groups and both outcomes say anything
    spoke = up.where("k > 1 and pb > 0 and pb < pn")
    row = spoke.agg(F.sum((F.col("b2") - p * p * F.col("pn")) / (p * (1 - p))), F.sum(F.col("k") - 1),
                    F.sum(F.col("pn") - F.col("n2") / F.col("pn") - (F.col("k") - 1))).head()
    if row[0] is None or row[2] <= 0:
        return WEIGHT_MAX
    rho = (row[0] - row[1]) / row[2]
    if rho <= 0:
        return WEIGHT_MAX
    return min(WEIGHT_MAX, max(WEIGHT_MIN, (1 - rho) / rho))


def reputation(hosts: DataFrame) -> DataFrame:
    """host, n, bad, posterior_mean, posterior_low of each host.

    No labelled page anywhere: the prior is even (0.5, one pseudo-outcome on each side) and nothing is blocked.
    """
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(0))
    total = suffixes.agg(F.sum("n"), F.sum("bad")).head()
    n, bad = total[0] or 0, total[1] or 0
    top = (bad + 1) / (n + 2)
    w_suffix, w_domain, w_host = prior_weight(suffixes, "all"), prior_weight(domains, "suffix"), prior_weight(hosts, "domain")

    def mean(weight: float, prior: Column) -> Column:
        return (F.lit(weight) * prior + F.col("bad")) / (F.lit(weight) + F.col("n"))

    s = suffixes.select("suffix", mean(w_suffix, F.lit(top)).alias("s_mean"))
    d = domains.join(s, "suffix").select("domain", mean(w_domain, F.col("s_mean")).alias("d_mean"))
    m, size = F.col("posterior_mean"), F.lit(w_host) + F.col("n")
    return hosts.join(d, "domain").withColumn("posterior_mean", mean(w_host, F.col("d_mean"))).select(
        "host", "n", "bad", "posterior_mean", (m - Z * F.sqrt(m * (1 - m) / (size + 1))).alias("posterior_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], bad_rate: float = BAD_RATE,
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, posterior_mean, posterior_low, verdict ('allow' or 'block') of every page row.

    A rule decides where one fits; else the host is blocked if its lower posterior bound exceeds ``bad_rate``.
    Null url or one without '://': host and path are empty, and the empty host is judged like any other.
    Rows that repeat stay; other columns of ``pages`` are not looked at.
    """
    host, path = F.col("host"), F.col("path")
    scores = reputation(stored(host_outcomes(pages, outcomes, page_id, url), "hosts")).drop("n", "bad")  # read once per level
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return rows.join(scores, "host").withColumn("_rule", rule_of(host, path, rules)).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), "posterior_mean", "posterior_low",
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("posterior_low") > bad_rate, "block").otherwise("allow")).alias("verdict"))
