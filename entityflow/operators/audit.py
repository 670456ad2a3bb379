"""Audit samples, changes between two states, reclassification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import AUDIT_STRATA
from ..functions.text import case_id
from ..functions.urls import host_key


def cases(resolutions: DataFrame, strata: tuple[str, ...] = AUDIT_STRATA) -> DataFrame:
    """Pending decisions of the strata, one row per (reason, url): queries (ascending set), host, case_id."""
    eligible = resolutions.filter((F.col("status") == "pending") & F.col("reason").isin(*strata))
    grouped = eligible.groupBy("reason", F.col("discovered_url").alias("url")).agg(F.array_sort(F.collect_set("query")).alias("queries"))
    return grouped.withColumn("host", host_key(F.col("url"))).withColumn("case_id", case_id(F.col("reason"), F.col("url")))


def sampled(found: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """`size` cases per reason in a seeded order, distinct hosts first, then the rest. The order is a
    hash, so the sample depends on neither input order nor partitions."""
    draw = F.sha2(F.concat_ws("\0", F.lit(str(seed)), "reason", "url"), 256)
    turn = F.row_number().over(Window.partitionBy("reason", "host").orderBy("_draw", "url"))
    place = F.row_number().over(Window.partitionBy("reason").orderBy(F.col("_turn") > 1, "_draw", "url"))
    drawn = found.withColumn("_draw", draw).withColumn("_turn", turn).withColumn("place", place.cast("long"))
    return drawn.filter(F.col("place") <= size).drop("_draw", "_turn")


def search_details(results: DataFrame) -> DataFrame:
    """results (query, url, title, snippet) -> query, url, titles, snippets (ascending distinct arrays)."""
    return results.groupBy("query", "url").agg(F.array_sort(F.collect_set("title")).alias("titles"), F.array_sort(F.collect_set("snippet")).alias("snippets"))


def changes(before: DataFrame, after: DataFrame, key: tuple[str, ...] = ("query", "discovered_url"), compared: tuple[str, ...] = tuple("status name url reason".split())) -> DataFrame:
    """Rows of after that differ from before in a compared column, with before_<column>; a row that was
    not there counts, a row that went does not."""
    old = before.select(*key, *(F.col(c).alias(f"before_{c}") for c in compared), F.lit(True).alias("_old"))
    differs = F.col("_old").isNull()
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"before_{c}"))
    return after.join(old, list(key), "left").filter(differs).drop("_old")


def reclassified(resolutions: DataFrame, reasons: tuple[str, ...] = ("non_institutional_source", "editorial_or_listing_page")) -> DataFrame:
    """Pending decisions of these reasons become skipped; a second time nothing changes."""
    hit = (F.col("status") == "pending") & F.col("reason").isin(*reasons)
    return resolutions.withColumn("status", F.when(hit, "skipped").otherwise(F.col("status")))


def tallies(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
