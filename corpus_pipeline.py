"""The training-data pipeline: five of the operators of entityflow.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns of documents;
the last returns the mix. Between stages the rows are written as Parquet and read again, in the folder
of spark.checkpoint.dir, so that a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.llm import decontaminate, lang_id, minhash_dedup, mixing, secret_scan
from entityflow.llm.store import remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined, with `lang` set to it; declared `lang` and `source` are
    evidence beside the text. Null, empty and letterless texts are judged by their declaration; without one of
    a known language they go. Rows are judged one by one (null and repeated ids too); ties go to the
    first language of the alphabet; no rows give no rows; columns that documents lack are dropped."""
    found = lang_id.identify(docs.select(*COLUMNS), lang_id.train(docs), F.col("text"), F.col("lang"), F.col("source"))
    return found.filter("_accepted").withColumn("lang", F.col("_language")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five words and 0.8: that of the least doc_id (ties by the hash of
    the text; null ids last; of rows equal in id and text one). Null, empty and wordless texts all stay; no
    rows give no rows."""
    return minhash_dedup.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of a benchmark item. Rows are judged by their own text (null and
    repeated ids too); null and empty texts stay; no rows give no rows, no items remove none."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark; n_chars follows the text (a null text keeps
    both). Repeated rows are judged alike; no rows give no rows."""
    clean = secret_scan.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies, taken of each document. Null and empty texts
    have size 0; a null source is one of its own; repeated rows are rows of their own; no rows give no rows."""
    return mixing.mixed(docs)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", contamination), ("secret_scan", secrets), ("mixing", mixture)]
#: SQL has no trigram model, no fitted host priors and no randomness battery; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written to the shared folder and read again. What a stage
    wrote is removed once the next one is written; the last one's stays, as the result is read from it."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
