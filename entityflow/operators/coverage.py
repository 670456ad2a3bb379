"""How much of each query's result pages is there, and whether a run proves complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_coverage(pages: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """pages (query, page) -> query, pages, last_page, contiguous (pages are 1..last, none twice),
    failed_pages (array, ascending) from failures (query, page)."""
    got = pages.groupBy("query").agg(F.count(F.lit(1)).alias("pages"), F.max("page").alias("last_page"), F.min("page").alias("_first"), F.count_distinct("page").alias("_distinct"))
    whole = (F.col("_first") == 1) & (F.col("last_page") == F.col("_distinct")) & (F.col("pages") == F.col("_distinct"))
    out = got.select("query", "pages", "last_page", whole.alias("contiguous"))
    if failures is None:
        return out.withColumn("failed_pages", F.array().cast("array<int>"))
    failed = failures.groupBy("query").agg(F.array_sort(F.collect_set("page")).alias("failed_pages"))
    return out.join(failed, "query", "full").withColumn("failed_pages", F.coalesce("failed_pages", F.array().cast(failed.schema["failed_pages"].dataType)))


def duplicate_positions(pages: DataFrame, *key: str) -> DataFrame:
    return pages.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def without_first_page(queries: DataFrame, pages: DataFrame) -> DataFrame:
    return queries.select("query").join(pages.filter("page = 1").select("query").distinct(), "query", "left_anti")


def with_next(pages: DataFrame) -> DataFrame:
    """Distinct (query, page) with has_next: whether the page after it is there."""
    following = F.lead("page").over(Window.partitionBy("query").orderBy("page"))
    return pages.select("query", "page").distinct().withColumn("has_next", F.coalesce(following == F.col("page") + 1, F.lit(False)))


def coverage_status(failed: Column, run_reason: Column, last_page: Column, max_pages: Column) -> Column:
    """struct(status, reason): failed pages, then the run's own reason, then the page limit, else complete."""
    of = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    return F.when(failed > 0, of("incomplete", F.lit("apify_search_page_failed"))).when(run_reason != "", of("incomplete", run_reason)).when(last_page >= max_pages, of("limited", F.lit("max_pages"))).otherwise(of("complete", F.lit("")))


def completion_reason(cost: Column, cap: Column, status: Column, exit_code: Column, pending: Column, handled: Column, records: Column) -> Column:
    """Empty where the evidence of a run proves that it is complete, else why not."""
    known = cost.isNotNull() & cap.isNotNull() & ~F.isnan(cost) & ~F.isnan(cap) & (F.abs(cost) < float("inf")) & (F.abs(cap) < float("inf"))
    proven = known & (cost >= 0) & (cap > 0) & status.eqNullSafe("SUCCEEDED") & exit_code.eqNullSafe(0) & pending.eqNullSafe(0) & handled.eqNullSafe(records)
    return F.when(known & (cap > 0) & (cost >= cap), "apify_cost_limit").when(proven, "").otherwise("apify_completion_unverified")


def merged_positions(successes: DataFrame, failures: DataFrame) -> DataFrame:
    """Both (query, page) sets: outcome is success, both (the page stays, coverage is incomplete) or
    marker (an empty page with search_error)."""
    good = successes.select("query", "page").distinct().withColumn("_good", F.lit(True))
    bad = failures.select("query", "page").distinct().withColumn("_bad", F.lit(True))
    outcome = F.when(F.col("_good") & F.col("_bad"), "both").when(F.col("_good"), "success").otherwise("marker")
    return good.join(bad, ["query", "page"], "full").select("query", "page", outcome.alias("outcome"))


def exit_code(interrupted: bool, progress: DataFrame, resolutions: DataFrame) -> int:
    """130 if interrupted, 2 if a query is not complete or a decision is pending, else 0."""
    if interrupted:
        return 130
    unfinished = progress.filter("status is null or status <> 'complete'").limit(1).count()
    return 2 if unfinished or resolutions.filter("status = 'pending'").limit(1).count() else 0


def finished_queries(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Queries none of whose jobs (query, id) is left."""
    left = jobs.join(done.select("id").distinct(), "id", "left_anti").select("query").distinct()
    return jobs.select("query").distinct().join(left, "query", "left_anti")
