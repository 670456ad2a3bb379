"""Agreement of weak identity signals, relationally (pages without structured identity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weak_agreement(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """pages (page), signals (page, pos, context, name, key) -> page, name, conflict.

    A key qualifies with two contexts, one of them not the title. One qualifying key gives the name of
    its first signal, unless a copyright owner disagrees; several conflict; none gives no name.
    """
    grouped = signals.filter("key <> ''").groupBy("page", "key").agg(F.count_distinct("context").alias("contexts"), F.bool_or(F.col("context") != "title").alias("other"), F.min_by("name", "pos").alias("name"))
    one = grouped.filter("contexts >= 2 and other").groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("match"), F.min("name").alias("name"))
    owners = signals.filter("context = 'copyright'").select("page", F.col("key").alias("owner")).join(one.select("page", "match"), "page").groupBy("page").agg(F.bool_or(F.col("owner") != F.col("match")).alias("denied"))
    joined = pages.join(one, "page", "left").join(owners, "page", "left")
    denied = F.coalesce("denied", F.lit(False))
    return joined.select("page", F.when((F.col("n") == 1) & ~denied, F.col("name")).alias("name"), F.coalesce((F.col("n") > 1) | ((F.col("n") == 1) & denied), F.lit(False)).alias("conflict"))
