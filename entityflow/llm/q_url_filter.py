"""op4: verdicts on the urls of pages. Labels of a page are those of the same id in `labels`: quality
1 is a good outcome; pages without a label count towards no host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import LONG_SUFFIXES, MOST_STRENGTH, RULES, filter_urls, host_of


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    outcomes = pages.join(labels, "page_id").select(host_of(F.col("url")).alias("host"), "good")
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    two, three = "array_to_string(string_split(host, '.')[-2:], '.')", "array_to_string(string_split(host, '.')[-3:], '.')"
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    suffix = f"CASE WHEN {two} IN ({long}) AND host <> {two} THEN {two} ELSE string_split(host, '.')[-1] END"
    domain = f"CASE WHEN length({suffix}) = length({two}) THEN {three} ELSE {two} END"
    strength = lambda level: f"""(SELECT CASE WHEN k < 2 OR v <= 0 OR (s - (k - 1) * (v / n)) / (n - nn / n) <= (v / n) / {MOST_STRENGTH + 1} THEN {MOST_STRENGTH}
        ELSE greatest(1.0, (v / n) / ((s - (k - 1) * (v / n)) / (n - nn / n)) - 1) END
        FROM (SELECT sum(n * (good / n - mean) * (good / n - mean)) AS s, count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(n * mean * (1 - mean)) AS v FROM {level}))"""  # noqa: E731
    posterior = lambda level: f"""SELECT *, alpha / (alpha + beta) AS rate, sqrt(alpha / (alpha + beta) * (1 - alpha / (alpha + beta)) / (alpha + beta + 1)) AS sd
        FROM (SELECT *, {strength(level)} * mean + good AS alpha, {strength(level)} * (1 - mean) + n - good AS beta FROM {level})"""  # noqa: E731
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    return f"""WITH p AS (SELECT *, {suffix} AS suffix, {domain} AS domain FROM (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
    h0 AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS good FROM p JOIN labels l ON l.doc_id = p.page_id WHERE quality IS NOT NULL AND host <> '' GROUP BY ALL),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h0 GROUP BY ALL),
    s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT sum(good) / sum(n) FROM h0) AS mean FROM d0 GROUP BY suffix),
    s AS ({posterior("s0")}), d1 AS (SELECT d0.*, s.rate AS mean FROM d0 JOIN s ON s.suffix = d0.suffix),
    d AS ({posterior("d1")}), h1 AS (SELECT h0.*, d.rate AS mean FROM h0 JOIN d ON d.domain = h0.domain),
    h AS ({posterior("h1")}),
    r(verdict, host, path) AS (VALUES {rules}),
    fit AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM p, r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
    SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN coalesce(h.rate, d.rate, s.rate, (SELECT sum(good) / sum(n) FROM h0), 0.5) + 1.645 * coalesce(h.sd, d.sd, s.sd, 0.5) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN fit ON fit.page_id = p.page_id LEFT JOIN h ON h.host = p.host LEFT JOIN d ON d.domain = p.domain LEFT JOIN s ON s.suffix = p.suffix"""


QUERIES = {"op4_url_filter": op4_url_filter}
SQL = {"op4_url_filter": _sql()}
