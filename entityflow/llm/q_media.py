"""op5: documents as WAV media, read back and fingerprinted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .media import media_columns


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("media", "fingerprints"))


QUERIES = {"op5_media_columns": op5_media_columns}
SQL: dict[str, str] = {}
