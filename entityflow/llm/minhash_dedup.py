"""MinHash near-dedup (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import Likeness, near_classes
from .store import row_key, small_side

#: 24 bands of 5 of 120 minima: a pair at 0.8 is missed with probability 7e-5, at 0.85 with 8e-7.
DOCUMENTS = Likeness(shingle=5, part=80, whole=100, bands=24, rows=5)


def near_duplicates(docs: DataFrame, how: Likeness = DOCUMENTS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and are components of their own.
    A null doc_id is never the id of a component: such a row has the component of its text and goes,
    or has null and stays where no partner has an id. Rows that repeat a
    doc_id are judged by their own text and share the fate of that id. No rows give no rows; other
    columns are not read.
    """
    found = near_classes(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), how)
    component = F.coalesce("class", "id")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, how: Likeness = DOCUMENTS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, without the near-copies: of each component the document of the least id.

    Rows are judged one by one: rows of one id are documents of their own, a null id comes behind all others,
    and of rows that are equal in id and text one stays (any of them, where other columns differ). Null and
    empty texts, and texts without words, stay, all of them. No rows give no rows.
    """
    key, found = row_key(id, text), near_classes(docs.select(row_key(id, text).alias("id"), F.col(text).cast("string").alias("text")), how).filter("class is not null")
    counted = found.groupBy("id").agg((F.first("class") == F.col("id")).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not stays")
    marked = small_side(counted.select(F.col("id").alias("_key"), F.col("stays").alias("_stays")))
    single = docs.join(marked, key == F.col("_key"), "left_anti")
    if not marked.filter("_stays").head(1):
        return single
    again = docs.withColumn("_row", key).join(marked.filter("_stays"), F.col("_row") == F.col("_key"), "left_semi")
    return single.unionByName(again.dropDuplicates(["_row"]).drop("_row"))
