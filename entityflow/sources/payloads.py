"""Stored result pages: two JSON dialects to one typed row, and checks of data-set records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RESULT = "title string, url string, description string"
CURRENT = f"provider string, organicResults array<struct<{_RESULT}>>, has_next boolean, end_status string, end_reason string, search_error boolean, searchQuery struct<term:string,page:int>"
LEGACY = "search_metadata struct<status:string>, search_information struct<organic_results_state:string>, organic_results array<struct<title:string,link:string,snippet:string>>, serpapi_pagination struct<next:string,next_link:string>"
RESULTS = "array<struct<title:string,url:string,snippet:string>>"


def json_type(payload: Column, path: str) -> Column:
    """JSON type name at a path, null without a value."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), path, "variant")), r"^[A-Z]+", 0)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (query, start, payload, ...) with results, next_start, end_status, end_reason,
    search_error and problem (null, or why the payload is not valid; then the rest is null).

    A payload whose provider is apify-google is of the current dialect (next page 10 further), any other
    of the older one (the next offset stands in a link and must lie further on). Types are strict: a
    number or string is no boolean. An error marker has no results and a next page or end.
    """
    from ..functions.urls import next_offset

    now, old = F.from_json("payload", CURRENT), F.from_json("payload", LEGACY)
    rows = pages.withColumn("_now", now).withColumn("_old", old)
    current = F.col("_now.provider").eqNullSafe("apify-google")
    kinds = {c: json_type(F.col("payload"), f"$.{c}") for c in ("organicResults", "has_next", "end_status", "end_reason", "search_error")}
    bad_url = F.exists("_now.organicResults", lambda r: r["url"].isNull() | (r["url"] == ""))
    wrong = (
        F.when(~kinds["organicResults"].eqNullSafe("ARRAY") | F.coalesce(bad_url, F.lit(False)), "organic_result")
        .when(~kinds["has_next"].eqNullSafe("BOOLEAN"), "has_next")
        .when(~kinds["end_status"].eqNullSafe("STRING") | ~kinds["end_reason"].eqNullSafe("STRING"), "end_state")
        .when(kinds["search_error"].isNotNull() & (kinds["search_error"] != "BOOLEAN"), "search_error")
        .when(F.coalesce(F.col("_now.search_error"), F.lit(False)) & (F.size("_now.organicResults") > 0), "search_error")
    )
    empty = F.col("_old.search_information.organic_results_state").eqNullSafe("Fully empty")
    wrong_old = F.when(~F.col("_old.search_metadata.status").eqNullSafe("Success"), "search_status").when(F.col("_old.organic_results").isNull() & ~empty, "organic_results")
    problem = F.when(F.try_parse_json("payload").isNull(), "not_json").when(current, wrong).otherwise(wrong_old)
    results = F.when(current, F.transform("_now.organicResults", lambda r: F.struct(F.coalesce(r["title"], F.lit("")).alias("title"), r["url"].alias("url"), F.coalesce(r["description"], F.lit("")).alias("snippet")))).otherwise(
        F.transform(F.filter(F.coalesce("_old.organic_results", F.array().cast("array<struct<title:string,link:string,snippet:string>>")), lambda r: r["link"].isNotNull()), lambda r: F.struct(F.coalesce(r["title"], F.lit("")).alias("title"), r["link"].alias("url"), F.coalesce(r["snippet"], F.lit("")).alias("snippet")))
    )
    link = F.coalesce("_old.serpapi_pagination.next", "_old.serpapi_pagination.next_link")
    following = F.when(current, F.when(F.col("_now.has_next"), F.col("start") + 10)).otherwise(next_offset(link, F.col("start")))
    out = rows.withColumn("problem", problem)
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    return out.withColumns({"results": ok(results), "next_start": ok(following), "end_status": ok(F.when(current, F.col("_now.end_status")).otherwise("complete")), "end_reason": ok(F.when(current, F.col("_now.end_reason")).otherwise("")), "search_error": ok(current & F.coalesce(F.col("_now.search_error"), F.lit(False)))}).drop("_now", "_old")


def exploded(pages: DataFrame) -> DataFrame:
    """One row per result of parsed pages: query, start, place, title, url, snippet."""
    return pages.select("query", "start", F.posexplode("results").alias("place", "r")).select("query", "start", "place", "r.title", "r.url", "r.snippet")


def record_problems(records: DataFrame, batch: DataFrame, max_pages: int) -> DataFrame:
    """records (record, payload) of a data set -> record, term, page, problem (null if valid):
    unexpected (no query of the batch, or page not an integer in 1..max_pages), organic_result, or
    duplicate (the position stands in an earlier record too)."""
    from pyspark.sql import Window

    rows = records.withColumn("_p", F.from_json("payload", "organicResults array<struct<title:string,url:string>>, searchQuery struct<term:string,page:int>"))
    integer = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.searchQuery.page", "variant")).eqNullSafe("BIGINT")
    rows = rows.select("record", F.col("_p.searchQuery.term").alias("term"), F.when(integer, F.col("_p.searchQuery.page")).alias("page"), F.col("_p.organicResults").alias("_r"))
    known = batch.select(F.col("query").alias("term")).distinct().withColumn("_known", F.lit(True))
    first = F.min("record").over(Window.partitionBy("term", "page"))
    bad = F.col("_r").isNull() | F.exists("_r", lambda r: r["url"].isNull() | (r["url"] == ""))
    problem = F.when(F.col("_known").isNull() | F.col("page").isNull() | ~F.col("page").between(1, max_pages), "unexpected").when(bad, "organic_result").when(F.col("record") > first, "duplicate")
    return rows.join(known, "term", "left").withColumn("problem", problem).select("record", "term", "page", "problem")


def mapped_failure(request_url: Column, terms: Column, max_pages: int) -> Column:
    """struct(term, page) of a failed request for a result page of the batch, or null: http(s) without
    credentials, default port, a google host, /search, one q among terms, at most one start, a
    multiple of 10 within the depth."""
    from ..functions.urls import authority, hostname, port, query_value, raw_path, raw_query, scheme

    q = F.concat(F.lit("&"), raw_query(request_url))
    times = lambda name: F.size(F.regexp_extract_all(q, F.lit(f"&{name}="), F.lit(0)))
    start = F.coalesce(query_value(request_url, "start"), F.lit("0"))
    number = F.when(start.rlike(r"^\d{1,6}$"), start).cast("int")
    term = query_value(request_url, "q")
    host_ok = hostname(request_url).rlike(r"^(?:www\.)?google\.[a-z]{2,3}(?:\.[a-z]{2})?$")
    good = scheme(request_url).isin("http", "https") & ~F.contains(authority(request_url), F.lit("@")) & port(request_url).isin("", "80", "443") & host_ok & (raw_path(request_url) == "/search")
    good = good & (times("q") == 1) & (times("start") <= 1) & F.array_contains(terms, term) & (number % 10 == 0) & (number / 10 < max_pages)
    return F.when(good, F.struct(term.alias("term"), (number / 10 + 1).cast("int").alias("page")))
