"""URL filters by rules and by empirical-Bayes host reputation (operator 4). DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: Strength (pseudo-count) of a prior where children differ no more than by chance.
MOST_STRENGTH = 1000.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://, null for null."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES) & (host != two), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    three, two = F.substring_index(host, ".", -3), F.substring_index(host, ".", -2)
    return F.when(F.length(suffix_of(host)) == F.length(two), three).otherwise(two)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def _strength(children: DataFrame) -> float:
    """Pseudo-counts of the beta prior of children (n, good, mean of the parent), by the moments of the
    beta-binomial: the variance between children beyond that within them."""
    m = F.col("mean")
    got = children.filter("n > 0").agg(F.sum(F.col("n") * (F.col("good") / F.col("n") - m) * (F.col("good") / F.col("n") - m)).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("n") * m * (1 - m)).alias("v")).first()
    if not got["k"] or got["k"] < 2 or got["v"] <= 0:
        return MOST_STRENGTH
    within = got["v"] / got["n"]
    spread = (got["s"] - (got["k"] - 1) * within) / (got["n"] - got["nn"] / got["n"])
    return MOST_STRENGTH if spread <= within / (MOST_STRENGTH + 1) else max(1.0, within / spread - 1)


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """outcomes (host, good 0/1, null left out) -> hosts, domains and suffixes with n, good and posterior
    alpha and beta, and the overall rate. Each level's prior is the posterior mean of the level above
    with a strength estimated from the spread of all its children."""
    hosts = outcomes.filter("good is not null and host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    overall = (good or 0) / n if n else 0.5

    def posterior(level: DataFrame) -> DataFrame:
        k = F.lit(_strength(level))
        level = level.withColumn("alpha", k * F.col("mean") + F.col("good")).withColumn("beta", k * (1 - F.col("mean")) + F.col("n") - F.col("good"))
        return level.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    suffixes = posterior(suffixes.withColumn("mean", F.lit(overall)))
    domains = posterior(domains.join(suffixes.select("suffix", F.col("rate").alias("mean")), "suffix"))
    hosts = posterior(hosts.drop("suffix").join(domains.select("domain", F.col("rate").alias("mean")), "domain"))
    return hosts, domains, suffixes, overall


def filter_urls(pages: DataFrame, outcomes: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, least_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, rate, bound.

    outcomes (host, good): labelled pages, good 0 or 1. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest wins. Without a rule a url is blocked if the upper posterior
    bound (mean + z deviations) of its host's rate of good pages is below least_rate: a host is
    blocked only on evidence. A host without labels has its domain's posterior, else its suffix's, else
    the overall rate. Null urls and those without :// have empty host and path and the overall rate;
    repeated rows are judged alike; no outcomes block nothing; no rows give no rows.
    """
    hosts, domains, suffixes, overall = reputation(outcomes)
    named = pages.select(F.col(id).alias("page_id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    belief = lambda x: F.struct(F.col("rate"), F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("alpha") + F.col("beta") + 1)).alias("sd"))  # noqa: E731, ARG005
    own = named.join(hosts.select("host", belief(0).alias("_h")), "host", "left").withColumn("_domain", domain_of(F.col("host"))).withColumn("_suffix", suffix_of(F.col("host")))
    own = own.join(domains.select(F.col("domain").alias("_domain"), belief(0).alias("_d")), "_domain", "left")
    own = own.join(suffixes.select(F.col("suffix").alias("_suffix"), belief(0).alias("_s")), "_suffix", "left")
    known = F.coalesce("_h", "_d", "_s", F.struct(F.lit(overall).alias("rate"), F.lit(0.5).alias("sd")))
    judged = own.withColumn("_known", known).withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    bound = F.col("_known.rate") + z * F.col("_known.sd")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(bound < least_rate, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_known.rate").alias("rate"), bound.alias("bound"))
