"""Query lists: one query per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every line boundary: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def lines(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """Distinct trimmed lines that are not blank, with the place (from 0) of their first occurrence."""
    whole = F.regexp_replace(F.col(text), "^﻿", "")
    split = rows.select(*key, F.posexplode(F.split(whole, _ENDS, -1)).alias("pos", "line"))
    trimmed = F.regexp_replace("line", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return split.select(*key, trimmed.alias("line"), F.col("pos").cast("long")).filter("line <> ''").groupBy(*key, "line").agg(F.min("pos").alias("pos"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query, pos of a UTF-8 file, in any order; sort by pos for the file's."""
    return lines(spark.read.text(path, wholetext=True), "value").withColumnRenamed("line", "query")
