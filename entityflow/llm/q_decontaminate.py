"""op2: words of documents that stand in benchmark windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_matches


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def decontamination_ctes(table: str, window: int = 10) -> str:
    """CTEs up to found(doc_id, n_words, n_hit, n_items, items_sha256)."""
    return f"""
    dw AS (SELECT doc_id, {_WORDS} AS w FROM {table}),
    iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT item_id, least(len(w), {window}) AS k, unnest([array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), {window}) + 2)]) AS s FROM iw WHERE len(w) > 0),
    ks AS (SELECT DISTINCT k FROM win),
    dwin AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM dw, ks WHERE len(w) >= k),
    occ AS (SELECT d.doc_id, d.p, d.k, win.item_id FROM dwin d JOIN win ON win.s = d.s AND win.k = d.k),
    cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM occ)) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id),
    found AS (SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, coalesce(its.h, sha256('')) AS items_sha256
        FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id)"""


SQL = {"op2_benchmark_decontamination": f"WITH {decontamination_ctes('documents')} SELECT *, n_hit > 0 AS contaminated FROM found"}
