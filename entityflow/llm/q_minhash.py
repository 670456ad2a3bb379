"""op3: near-duplicates of documents at three words and 0.85."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .minhash_dedup import near_duplicates
from .neardup import Likeness

HOW = Likeness(shingle=3, part=85, whole=100, bands=24, rows=5)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), HOW).select("doc_id", "n_shingles", "component_id", "kept")


def near_dup_ctes(table: str, shingle: int, part: int, whole: int) -> str:
    """CTEs up to component(doc_id, component_id) and sets(doc_id, n_shingles) for a table."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(shingle))
    return f"""
    words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
    grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([{gram} FOR i IN range(1, len(w) - {shingle - 2})]) END AS g FROM words),
    sets AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM grams),
    flat AS (SELECT doc_id, unnest(g) AS s FROM grams),
    links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM flat x JOIN flat y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
        JOIN sets sa ON sa.doc_id = p.a JOIN sets sb ON sb.doc_id = p.b WHERE {whole} * p.n >= {part} * (sa.n_shingles + sb.n_shingles - p.n)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM {table} UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
    component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
SQL = {
    "op3_minhash_near_dedup": f"""WITH RECURSIVE {near_dup_ctes("documents", 3, 85, 100)}
    SELECT s.doc_id, s.n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sets s JOIN component c ON c.doc_id = s.doc_id"""
}
