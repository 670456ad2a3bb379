"""Which pages and results a run looks at, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_suffixes

#: Most domains of a gate.
MOST_LISTED = 10_000


def unseen(results: DataFrame) -> DataFrame:
    """results (query, idx, url, ...): rows whose url is not on an earlier page of the query. Repeats
    inside one page stay."""
    first = F.min("idx").over(Window.partitionBy("query", "url"))
    return results.withColumn("_first", first).filter("idx = _first").drop("_first")


def stop_pages(pages: DataFrame, results: DataFrame, max_pages: int) -> DataFrame:
    """Where each query's chain of pages ends: query, idx, status, reason.

    pages: query, idx (from 1), has_next, end_status, end_reason, search_error; results: query, idx, url.
    In order: results but none of them new; no next page; an empty page with a next one that is not an
    error marker; the page limit. A query without a stop keeps its last page, with null status.
    """
    first = results.groupBy("query", "url").agg(F.min("idx").alias("idx"))
    fresh = first.groupBy("query", "idx").agg(F.count(F.lit(1)).alias("n_new"))
    shown = results.groupBy("query", "idx").agg(F.count(F.lit(1)).alias("n"))
    counted = pages.join(shown, ["query", "idx"], "left").join(fresh, ["query", "idx"], "left").fillna(0, ["n", "n_new"])
    end = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    stop = (
        F.when((F.col("n") > 0) & (F.col("n_new") == 0), end("incomplete", "repeated_results"))
        .when(~F.col("has_next"), F.struct(F.col("end_status").alias("status"), F.col("end_reason").alias("reason")))
        .when((F.col("n") == 0) & ~F.col("search_error"), end("incomplete", "empty_page_with_next"))
        .when(F.col("idx") >= max_pages, end("limited", "max_pages"))
    )
    placed = counted.select("query", "idx", stop.alias("stop"))
    stops = placed.groupBy("query").agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("idx", "stop"))).alias("s"), F.max("idx").alias("last"))
    return stops.select("query", F.coalesce("s.idx", "last").alias("idx"), F.col("s.stop.status").alias("status"), F.col("s.stop.reason").alias("reason"))


def interleaved(jobs: DataFrame, host: str = "host", position: str = "pos") -> DataFrame:
    """jobs with rank: hosts take turns, in the order of their first position."""
    order = Window.partitionBy(host)
    turn, lead = F.row_number().over(order.orderBy(position)), F.min(position).over(order)
    return jobs.withColumn("turn", turn.cast("long")).withColumn("lead", lead)


def ready_heads(jobs: DataFrame, busy: DataFrame) -> DataFrame:
    """The first waiting job of every host that is not busy: host, id."""
    return jobs.groupBy("host").agg(F.min("id").alias("id")).join(busy.select("host").distinct(), "host", "left_anti")


def work_left(results: DataFrame, resolutions: DataFrame, retry_pending: bool = False) -> DataFrame:
    """Results without a stored decision, or (on retry) with a pending one."""
    done = resolutions.filter("status <> 'pending'") if retry_pending else resolutions
    return results.join(done.select("query", F.col("discovered_url").alias("url")).distinct(), ["query", "url"], "left_anti")


def gated(urls: DataFrame, listed: DataFrame, host: str = "host") -> DataFrame:
    """urls with kind: that of the listed domain that equals the host or a parent of it, else null.

    listed (domain, kind) is a dimension of MOST_LISTED rows at most, which is checked: no join, no shuffle.
    No two listed domains contain one another, so a row has one match at most.
    """
    rows = listed.select("domain", "kind").limit(MOST_LISTED + 1).collect()
    if len(rows) > MOST_LISTED:
        raise ValueError("too_many_listed_domains")
    return urls.withColumn("kind", gate_kind(F.col(host), {r["domain"]: r["kind"] for r in rows}) if rows else F.lit(None).cast("string"))


def looked_up(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored pages (query, start, ...) that are wanted (query, start)."""
    return stored.join(wanted.select("query", "start"), ["query", "start"], "left_semi")


def saved(stored: DataFrame) -> DataFrame:
    """stored (query, start, ...) with place: the page's number within its query, by its offset."""
    return stored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("start")).cast("long"))


def repaired(progress: DataFrame, pages: DataFrame) -> DataFrame:
    """progress (query, status, ...): incomplete queries without a stored page become not_started."""
    having = pages.select("query").distinct().withColumn("_has", F.lit(True))
    status = F.when((F.col("status") == "incomplete") & F.col("_has").isNull(), "not_started").otherwise(F.col("status"))
    return progress.join(having, "query", "left").withColumn("status", status).drop("_has")


def gate_kind(host: Column, listed: dict[str, str]) -> Column:
    """The same for a dimension of known size as a map literal: no join and no shuffle."""
    table = F.create_map(*(F.lit(x) for pair in sorted(listed.items()) for x in pair))
    kinds = F.transform(host_suffixes(host), lambda d: F.try_element_at(table, d))
    return F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))


def redirect_targets(hops: DataFrame, start: DataFrame, most: int = 6) -> DataFrame:
    """hops (url, location), start (url) -> url, final, hops, error: at most `most` requests a chain.

    A bounded chain of equality joins; a url without a hop is final."""
    state = start.select("url", F.col("url").alias("at"), F.lit(1).alias("hops"), F.lit(True).alias("open"))
    step = hops.select(F.col("url").alias("at"), "location")
    for _ in range(most):
        state = state.join(step, "at", "left").select(
            "url",
            F.when(F.col("open"), F.coalesce("location", "at")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("open") & F.col("location").isNotNull(), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
            (F.col("open") & F.col("location").isNotNull()).alias("open"),
        )
    return state.select("url", F.when(F.col("hops") <= most, F.col("at")).alias("final"), "hops", F.when(F.col("hops") > most, "redirect_limit").alias("error"))
