"""op1: the language of every document and every page. A document's declared language is its `lang` and
its address its `source`; a page's are the lang attribute of its html element and its host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang_id import host_of, identify, markup_language, train, visible_text


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = F.lit(None).cast("long")
    rows = docs.select("doc_id", none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("address"))
    rows = rows.unionByName(pages.select(none.alias("doc_id"), "page_id", visible_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("address")))
    found = identify(rows, train(docs), F.col("text"), F.col("declared"), F.col("address"), keep=["doc_id", "page_id"])
    return found.select("doc_id", "page_id", F.col("_language").alias("language"), F.col("_probability").alias("probability"), F.col("_accepted").alias("accepted"))


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
