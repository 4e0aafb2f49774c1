"""URL filtering by the reputation of hosts: beta-binomial shrinkage from suffix to domain to host.

Labelled outcomes of pages are counted per host. Counts are shrunk level by
level: the rate of a suffix towards the overall rate, of a registered domain
towards its suffix, of a host towards its domain. How strongly, follows from how
far the groups of a level scatter around their parents beyond binomial noise
(moment estimate after Kleinman, 1973). A host is blocked when a lower bound of
the posterior of its rate of bad pages is above a limit. Explicit rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, sized, table
from veritab.llm.html_text import host_of

Z = 1.645
MAX_BAD = 0.5
LARGEST_WEIGHT = 1e4
# Public suffixes of two labels that are common; others are the last label.
SECOND_LEVEL = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
                "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]


def path_of(url: str) -> Column:
    """What follows the host of a url column up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: str, path: str, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; rules are ``(host/path, verdict)``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _weight(children: DataFrame, n: str, k: str, parent_n: str, parent_k: str) -> float:
    """Prior weight, in observations, of a parent's rate for its children."""
    rate = (F.col(parent_k) + 0.5) / (F.col(parent_n) + 1.0)
    noise = rate * (1 - rate)
    row = children.agg(
        F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - rate, 2) / noise).alias("s"), F.count(F.lit(1)).alias("groups"),
        F.sum(n).alias("total")).first()
    if not row["groups"] or row["total"] <= row["groups"]:
        return 1.0
    excess = (row["s"] - row["groups"]) / (row["total"] - row["groups"])
    return min(LARGEST_WEIGHT, max(1.0, 1.0 / max(excess, 1e-9) - 1.0))


def _log_odds(alpha: Column, beta: Column, z: float) -> Column:
    """Lower bound of a beta variable: a normal bound on its log-odds, from digamma and trigamma."""

    def digamma(x: Column) -> Column:
        y = x + 3.0
        return F.log(y) - 0.5 / y - 1.0 / (12.0 * y * y) - 1.0 / x - 1.0 / (x + 1.0) - 1.0 / (x + 2.0)

    def trigamma(x: Column) -> Column:
        y = x + 3.0
        return (1.0 / y + 0.5 / (y * y) + 1.0 / (6.0 * y * y * y)
                + 1.0 / (x * x) + 1.0 / ((x + 1.0) * (x + 1.0)) + 1.0 / ((x + 2.0) * (x + 2.0)))

    low = digamma(alpha) - digamma(beta) - z * F.sqrt(trigamma(alpha) + trigamma(beta))
    return 1.0 / (1.0 + F.exp(-low))


def host_reputation(outcomes: DataFrame, z: float = Z, hosts: DataFrame | None = None) -> DataFrame:
    """``host, n, n_bad, bad_rate, bad_bound`` for every host of ``outcomes(host, bad)``; rows with a NULL are left out.

    Hosts of ``hosts(host)`` without outcomes get what their domain, else their
    suffix, else the overall rate says, with n = 0; empty names get nothing.
    """
    scratch = Scratch(outcomes.sparkSession)
    known = outcomes.filter("host IS NOT NULL AND bad IS NOT NULL")
    labelled = scratch.write(known.groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("k"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = scratch.write(labelled.groupBy("domain").agg(
        F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.min("suffix").alias("suffix")))
    suffixes = scratch.write(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")))
    total, bad = suffixes.agg(F.sum("sn"), F.sum("sk")).first()
    total, bad = total or 0.0, bad or 0.0
    overall = (bad + 0.5) / (total + 1.0)
    of_suffix = domains.join(suffixes, "suffix")
    of_domain = labelled.join(domains.drop("suffix"), "domain")
    w_suffix = _weight(suffixes.withColumn("an", F.lit(total)).withColumn("ak", F.lit(bad)), "sn", "sk", "an", "ak")
    w_domain = _weight(of_suffix, "dn", "dk", "sn", "sk")
    w_host = _weight(of_domain, "n", "k", "dn", "dk")
    suffix_rate = (F.col("sk") + w_suffix * overall) / (F.col("sn") + w_suffix)
    everyone = labelled
    if hosts is not None:
        others = hosts.select("host").filter("host != ''").distinct().join(labelled.select("host"), "host", "left_anti")
        everyone = labelled.unionByName(others.select(
            "host", F.lit(0.0).alias("n"), F.lit(0.0).alias("k"), domain_of(F.col("host")).alias("domain"),
            suffix_of(F.col("host")).alias("suffix")))
    placed = everyone.join(domains.drop("suffix"), "domain", "left").join(suffixes, "suffix", "left").fillna(
        0.0, ["dn", "dk", "sn", "sk"])
    prior = (F.col("dk") + w_domain * suffix_rate) / (F.col("dn") + w_domain)
    alpha = F.col("k") + w_host * prior
    beta = F.col("n") - F.col("k") + w_host * (1 - prior)
    return placed.select(
        "host", "n", F.col("k").alias("n_bad"), (alpha / (alpha + beta)).alias("bad_rate"),
        _log_odds(alpha, beta, z).alias("bad_bound"))


def filtered_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (),
                  max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_bound`` for every row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` holds labelled outcomes, 1 for bad; of several for
    one page the largest counts. ``verdict`` is the longest fitting rule's, else
    ``block`` where the host's lower bound of the bad rate is above ``max_bad``,
    else ``allow``. Hosts without outcomes are judged by their domain, suffix or the
    overall rate. A NULL url or one without ``://`` has an empty host and path, fits
    no rule and is judged only where such pages have outcomes (else bound NULL). Repeated rows
    are judged each; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    located = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url")).select(
        "page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    judged = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = scratch.write(host_reputation(located.join(judged, "page_id").select("host", "bad"), z, located))
    rule, verdict = rule_for("host", "path", rules)
    bound = reputation.select("host", "bad_bound")
    return located.join(sized(bound, bound.count()), "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
        "bad_bound")


# The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block")]


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page is a copy of the document its path numbers; the document's quality label is the page's outcome."""
    number = F.regexp_extract(path_of("url"), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    numbered = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return numbered.join(bad, "doc_id").select("page_id", "bad")


@query("op1_filtered_urls")
def _filtered_urls(spark, folder):
    pages = table(spark, folder, "pages")
    return filtered_urls(pages, labelled_outcomes(pages, table(spark, folder, "labels")), RULES)
