"""op10: words that a mix of sources takes of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mixed


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_ctes(table: str) -> str:
    """CTEs up to mix(doc_id, source, size, source_size, target, copies, taken)."""
    return f"""
    sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}),
    src AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
    filled AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
        coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wbelow FROM src),
    level AS (SELECT (total - 3 * below)::DOUBLE AS rest, (weight - wbelow)::DOUBLE AS rw FROM filled
        WHERE 3 * source_size * (weight - wbelow) > (total - 3 * below) * w ORDER BY source_size::DOUBLE / w, source NULLS LAST LIMIT 1),
    shares AS (SELECT source, source_size, least(rest * w / rw, source_size::DOUBLE * 3) AS target,
        ('0x' || substr(md5(coalesce(source, chr(0))), 1, 5))::INT / 1048576.0::DOUBLE AS u FROM src, level),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12), doc_id NULLS FIRST, size) - 1 AS r FROM sized),
    rated AS (SELECT p.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM placed p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source),
    tries AS (SELECT source, j, any_value(target) AS target, any_value((u + j / 32.0::DOUBLE) - floor(u + j / 32.0::DOUBLE)) AS o,
        sum(size * (floor((r + 1)::DOUBLE * rate + ((u + j / 32.0::DOUBLE) - floor(u + j / 32.0::DOUBLE))) - floor(r::DOUBLE * rate + ((u + j / 32.0::DOUBLE) - floor(u + j / 32.0::DOUBLE))))::BIGINT) AS t
        FROM rated, range(32) x(j) GROUP BY source, j),
    best AS (SELECT source, o FROM tries QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(t::DOUBLE - target), j) = 1),
    mix AS (SELECT doc_id, p.source, size, source_size, target, (floor((r + 1)::DOUBLE * rate + o) - floor(r::DOUBLE * rate + o))::BIGINT AS copies,
        size * (floor((r + 1)::DOUBLE * rate + o) - floor(r::DOUBLE * rate + o))::BIGINT AS taken FROM rated p JOIN best b ON p.source IS NOT DISTINCT FROM b.source)"""


QUERIES = {"op10_mix_sources": op10_mix_sources}
SQL = {"op10_mix_sources": f"WITH {mix_ctes('documents')} SELECT doc_id, size, source_size, target, taken FROM mix"}
