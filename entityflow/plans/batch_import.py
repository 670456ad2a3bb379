"""The records of a finished run as stored pages, coverage and batch state, in one commit or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import query_value
from ..operators import coverage, planner
from ..sources.payloads import json_type, mapped_failure
from ..state import KEYS, State, StateError, upserted

_RECORD = "`#error` boolean, `#debug` struct<method:string,url:string,retryCount:int,requestId:string>, searchQuery struct<term:string,page:int>"


def judged(records: DataFrame, queries: DataFrame, max_pages: int) -> DataFrame:
    """records (record: their order, payload), queries (query) of the batch -> record, term, page, failed,
    results (variant), retry_count, request_id, problem (null, or why the record blocks the import)."""
    kind = lambda path: json_type(F.col("payload"), path)
    rows = records.select("record", "payload", F.from_json("payload", _RECORD).alias("p")).withColumn("_url", F.col("p.`#debug`.url")).withColumn("_q", F.coalesce(query_value(F.col("_url"), "q"), F.lit("")))
    rows = rows.withColumn("_own", mapped_failure(F.col("_url"), F.array("_q"), max_pages))
    debug, said, own = F.col("p.`#debug`"), F.col("p.searchQuery"), F.col("_own")
    none = kind("$.organicResults").isNull() | (kind("$.organicResults") == "VOID") | (F.get_json_object("payload", "$.organicResults") == "[]")
    agrees = kind("$.searchQuery").isNull() | (said["term"].eqNullSafe(own["term"]) & said["page"].eqNullSafe(own["page"]))
    failed = F.coalesce(F.col("p.`#error`"), F.lit(False))
    good = F.coalesce(debug["method"] == "GET", F.lit(False)) & own.isNotNull() & F.coalesce(none, F.lit(False)) & agrees
    place = F.when(failed, F.when(good, own)).otherwise(F.struct(said["term"].alias("term"), said["page"].alias("page")))
    rows = rows.select(
        "record", failed.alias("failed"), place["term"].alias("term"), place["page"].alias("page"), kind("$.searchQuery").alias("_said"), kind("$.organicResults").alias("_kind"),
        F.when(~failed, F.try_variant_get(F.try_parse_json("payload"), "$.organicResults", "variant")).alias("results"), F.when(debug["retryCount"] >= 0, debug["retryCount"]).alias("retry_count"), F.when(debug["requestId"].rlike("^[A-Za-z0-9]{1,128}$"), debug["requestId"]).alias("request_id"),
    )
    known = queries.select(F.col("query").alias("term")).distinct().withColumn("_known", F.lit(True))
    first = F.min(F.when(~F.col("failed"), F.col("record"))).over(Window.partitionBy("term", "page"))
    problem = (
        F.when(F.col("failed"), F.when(F.col("_known").isNull() | F.col("page").isNull(), "apify_unmapped_search_error"))
        .when(~F.col("_said").eqNullSafe("OBJECT"), "apify_missing_search_query")
        .when(F.col("_known").isNull() | F.col("page").isNull() | ~F.col("page").between(1, max_pages), "apify_unexpected_query_or_page")
        .when(~F.col("_kind").eqNullSafe("ARRAY"), "apify_missing_organic_results")
        .when(F.col("record") > first, "apify_duplicate_query_page")
    )
    return rows.join(known, "term", "left").withColumn("problem", problem).drop("_known", "_said", "_kind")


def coverage_of(found: DataFrame, run_reason: Column, max_pages: int) -> DataFrame:
    """judged records without problems -> query, pages, last_page, failed_pages, status, reason, and first
    and positions, by which gaps show."""
    per = found.groupBy(F.col("term").alias("query")).agg(
        F.count_if(~F.col("failed")).cast("int").alias("pages"), F.max("page").alias("last_page"), F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("page")))).alias("failed_pages"), F.min("page").alias("first"), F.count_distinct("page").alias("positions")
    )
    end = coverage.coverage_status(F.size("failed_pages"), run_reason, F.col("last_page"), F.lit(max_pages))
    return per.withColumn("end", end).select("query", "pages", "last_page", "failed_pages", "end.status", "end.reason", "first", "positions")


def pages_of(found: DataFrame, covered: DataFrame) -> DataFrame:
    """The pages to store (query, start, payload): a success as it came, a position that only failed as an
    empty page with search_error."""
    one = found.groupBy(F.col("term").alias("query"), "page").agg(F.first(F.when(~F.col("failed"), F.to_json("results")), ignorenulls=True).alias("r"))
    rows = one.join(covered.select("query", "last_page", "status", "reason"), "query")
    results = F.coalesce("r", F.lit("[]"))
    rest = F.to_json(F.struct((F.col("page") < F.col("last_page")).alias("has_next"), F.col("status").alias("end_status"), F.col("reason").alias("end_reason"), F.struct(F.col("query").alias("term"), "page").alias("searchQuery"), F.when(F.col("r").isNull(), F.lit(True)).alias("search_error")))
    payload = F.concat(F.lit('{"provider":"apify-google","organicResults":'), results, F.lit(","), F.substring(rest, 2, 1 << 30))
    return rows.select("query", ((F.col("page") - 1) * 10).cast("int").alias("start"), payload.alias("payload"))


def import_batch(state: State, batch: int, records: DataFrame, evidence: dict, max_pages: int) -> dict:
    """Checks all records of the batch's run, then stores its pages, coverage and state in one commit. Any
    problem raises StateError with its reason and leaves the state as it was, the batch open.

    evidence: cost_usd, cost_limit_usd, status, exit_code, pending_requests, handled_requests, run_id."""
    spark = state.spark
    batches = state.table("batches")
    queries = batches.filter(F.col("id") == batch).select(F.explode("queries").alias("query"))
    n = records.count()
    found = judged(records, queries, max_pages)
    wrong = found.filter("problem is not null").orderBy("record").limit(1).collect()
    if wrong:
        raise StateError(wrong[0]["problem"])
    if not n:
        raise StateError("apify_empty_dataset")
    kinds = {"cost_usd": "double", "cost_limit_usd": "double", "status": "string", "exit_code": "int", "pending_requests": "int", "handled_requests": "int"}
    of = lambda k: F.lit(evidence.get(k)).cast(kinds[k])
    reason = coverage.completion_reason(of("cost_usd"), of("cost_limit_usd"), of("status"), of("exit_code"), of("pending_requests"), of("handled_requests"), F.lit(n))
    covered = coverage_of(found, reason, max_pages)
    if queries.join(covered.filter("first = 1"), "query", "left_anti").limit(1).count():
        raise StateError("apify_omitted_queries")
    if covered.filter("positions <> last_page").limit(1).count():
        raise StateError("apify_missing_intermediate_page")
    stored = state.table("pages")
    if stored.join(queries.distinct(), "query", "left_semi").filter("not coalesce(get_json_object(payload, '$.provider'), '') = 'apify-google'").limit(1).count():
        raise StateError("apify_legacy_offset_mapping_unverified")
    run = str(evidence.get("run_id") or "")
    new = covered.select("query", F.lit(batch).cast("long").alias("batch_id"), "pages", "last_page", "failed_pages", "status", "reason", F.lit(run).alias("run_id"))
    state.commit({
        "pages": upserted(stored, pages_of(found, covered), KEYS["pages"]),
        "coverage": upserted(state.table("coverage"), new, KEYS["coverage"]),
        "batches": planner.moved(batches, batch, "done"),
    })
    errors = [r.asDict() for r in found.filter("failed").orderBy("record").select(F.col("term").alias("query"), "page", F.lit("apify_search_page_failed").alias("reason"), "retry_count", "request_id").collect()]  # of one batch
    return {"dataset_records": n, "search_errors": errors, "completion_reason": spark.range(1).select(reason).first()[0]}
