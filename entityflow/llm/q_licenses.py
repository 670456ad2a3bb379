"""op6: license phrases and templates in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import CONTAINMENT, PHRASES, TEMPLATES, reach, scan_licenses


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts, labels = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.transform("blocks", lambda x: x["label"]))).alias("labels"), "score",
    )


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql() -> str:
    split = lambda t: t.replace(".", " ").split()
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS p, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(split(t)) - 2})) AS i FROM dw) WHERE w[i:i + {len(split(t)) - 1}] = {_list(split(t))}" for t, label in PHRASES)
    templates = ", ".join(f"({k}, '{label}', {_list(sorted(set(split(t))))}, {reach(t)})" for k, (label, t) in enumerate(TEMPLATES))
    return f"""WITH dw AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w FROM documents),
    base AS ({places}),
    b AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY doc_id),
    lines AS (SELECT doc_id, i, regexp_extract_all(line, {word}) AS s FROM (SELECT doc_id, unnest(string_split({lower}, chr(10))) AS line, generate_subscripts(string_split({lower}, chr(10)), 1) AS i FROM documents)),
    t(k, label, words, reach) AS (VALUES {templates}),
    placed AS (SELECT *, sum(len(s)) OVER (PARTITION BY doc_id ORDER BY i) - len(s) AS c FROM lines WHERE len(s) > 0),
    near AS (SELECT a.doc_id, a.i, b.c - a.c AS off, b.s FROM placed a JOIN placed b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.c - a.c < (SELECT max(reach) FROM t)),
    blocks AS (SELECT doc_id, i, reach, list_distinct(flatten(list(s))) AS s FROM near JOIN (SELECT DISTINCT reach FROM t) ON off < reach GROUP BY ALL),
    hit AS (SELECT doc_id, label, len(list_intersect(s, words))::DOUBLE / len(words) AS c FROM blocks JOIN t USING (reach) WHERE len(list_intersect(s, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9)),
    m AS (SELECT doc_id, max(c) AS c FROM hit GROUP BY doc_id),
    al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM hit UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id)
    SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word, coalesce(b.l, '') AS base_labels, coalesce(al.l, '') AS labels,
        greatest(coalesce(m.c, 0.0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
    FROM dw LEFT JOIN b ON b.doc_id = dw.doc_id LEFT JOIN m ON m.doc_id = dw.doc_id LEFT JOIN al ON al.doc_id = dw.doc_id"""


QUERIES = {"op6_license_scan": op6_license_scan}
SQL = {"op6_license_scan": _sql()}
