"""op8: secrets in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_scan import KINDS, spelled, with_spans


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("secrets_base")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.array_sort(F.concat(base, "secrets_random"))).alias("spans"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}
