"""op7: passages of documents that repeat in other documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .paragraph_dedup import LINES, repeated_passages


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), alike=LINES)


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Up to near(doc_id, p, n, first): lines in runs of 50 words of lines that have another
#: document in their class, where such lines of another document are in it too.
_NEAR = f"""
    parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    lines AS (SELECT doc_id, w, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) - len(w) AS p FROM (SELECT doc_id, line, {_WORDS} AS w FROM parts)),
    grams AS (SELECT doc_id, p, n, CASE WHEN n < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, n - 3)])) END AS g FROM lines WHERE n > 0),
    nodes AS (SELECT g, row_number() OVER (ORDER BY g) AS k FROM grams GROUP BY g),
    flat AS (SELECT k, unnest(g) AS s FROM nodes),
    similar_sets AS (SELECT a, b FROM (SELECT x.k AS a, y.k AS b, count(*) AS n FROM flat x JOIN flat y ON x.s = y.s AND x.k < y.k GROUP BY 1, 2) p
        JOIN nodes na ON na.k = a JOIN nodes nb ON nb.k = b WHERE 100 * n >= 80 * (len(na.g) + len(nb.g) - n)),
    either AS (SELECT a, b FROM similar_sets UNION ALL SELECT b, a FROM similar_sets),
    reached(a, b) AS (SELECT DISTINCT a, a FROM either UNION SELECT r.a, e.b FROM reached r JOIN either e ON e.a = r.b),
    classes AS (SELECT a AS k, min(b) AS c FROM reached GROUP BY a),
    classed AS (SELECT doc_id, p, n, coalesce(c, k) AS c FROM grams JOIN nodes USING (g) LEFT JOIN classes USING (k)),
    several AS (SELECT c FROM classed GROUP BY c HAVING count(DISTINCT doc_id) > 1),
    beside AS (SELECT doc_id, p, n, c, p - sum(n) OVER (PARTITION BY doc_id ORDER BY p) + n AS run FROM classed JOIN several USING (c)),
    members AS (SELECT doc_id, p, n, c FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, run) AS total FROM beside) WHERE total >= 50),
    firsts AS (SELECT c, min(doc_id) AS first FROM members GROUP BY c HAVING count(DISTINCT doc_id) > 1),
    near AS (SELECT doc_id, p, n, first FROM members JOIN firsts USING (c))"""
SQL = {
    "op7_substring_dedup": f"""WITH RECURSIVE {_NEAR},
    words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
    windows AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 50], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM words)),
    repeated AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(DISTINCT doc_id) > 1),
    held AS (SELECT doc_id, p, first FROM windows JOIN repeated USING (s)),
    equal AS (SELECT doc_id, i, NOT bool_or(first = doc_id) AS removed FROM (SELECT doc_id, first, unnest(range(p, p + 50)) AS i FROM held) GROUP BY doc_id, i),
    state AS (SELECT doc_id, i, bool_or(removed) AS removed FROM (SELECT * FROM equal UNION ALL SELECT doc_id, unnest(range(p::BIGINT, p::BIGINT + n)) AS i, first <> doc_id AS removed FROM near) GROUP BY doc_id, i),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, removed ORDER BY i) AS run FROM state),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS z, removed FROM runs GROUP BY doc_id, removed, run),
    links AS (SELECT doc_id AS a, first AS b FROM held UNION SELECT doc_id, first FROM near),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
    comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT s.doc_id, s.a AS start_word, s.z AS end_word, s.z - s.a AS n_words, removed, c AS component_id FROM spans s JOIN comp ON comp.a = s.doc_id"""
}
QUERIES = {"op7_substring_dedup": op7_substring_dedup}
