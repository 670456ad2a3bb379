"""The entry points: discovery over stored pages, recheck, export and audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frontier
from ..sinks import audit_bundle, export, recheck_files
from ..sources import payloads
from ..state import State
from .resolve import resolve

Resolver = Callable[[DataFrame, DataFrame], DataFrame]


def chain(pages: DataFrame) -> DataFrame:
    """Parsed pages (query, start, next_start, ...) that a query's chain reaches from its first page, with
    idx (from 1) and has_next. Offsets may grow by any step; pages beside the chain are left out.

    A query's pages are few (its depth), so each chain is a fold over one small sorted array."""
    steps = pages.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("start", "next_start"))).alias("p"))
    walk = """aggregate(p, named_struct('want', p[0].start, 'got', cast(array() as array<int>)), (a, x) ->
        case when x.start = a.want then named_struct('want', x.next_start, 'got', concat(a.got, array(x.start))) else a end, a -> a.got)"""
    placed = steps.select("query", F.posexplode(F.expr(walk)).alias("at", "start")).select("query", "start", (F.col("at") + 1).alias("idx"))
    return pages.join(placed, ["query", "start"]).withColumn("has_next", F.col("next_start").isNotNull())


def discover(state: State, corpus: DataFrame, max_pages: int = 3, retry_pending: bool = False, resolver: Resolver = resolve) -> DataFrame:
    """Decides what is new on the stored pages, commits decisions and progress at once, and returns the
    decisions made. A second run over an unchanged state decides nothing."""
    parsed = payloads.parsed(state.table("pages"))
    bad = parsed.filter("problem is not null").select("problem").first()
    if bad is not None:
        raise ValueError(bad["problem"])
    pages = chain(parsed)
    results = pages.select("query", "idx", F.explode("results").alias("r")).select("query", "idx", F.col("r.url").alias("url"))
    stops = frontier.stop_pages(pages, results, max_pages)
    repeated = F.col("reason").eqNullSafe("repeated_results") & (F.col("idx") == F.col("stop"))
    within = frontier.unseen(results).join(stops.select("query", F.col("idx").alias("stop"), "reason"), "query").filter(F.col("idx") <= F.col("stop")).filter(~repeated).select("query", "url").distinct()
    work = frontier.work_left(within, state.table("resolutions"), retry_pending)
    decided = resolver(work, corpus)
    progress = stops.select("query", F.coalesce("status", F.lit("incomplete")).alias("status"), F.coalesce("reason", F.lit("cached_continuation_unverified_use_new_run")).alias("reason"))
    state.upsert(resolutions=decided, progress=progress)
    made = state.table("resolutions").join(work.select("query", F.col("url").alias("discovered_url")), ["query", "discovered_url"], "left_semi")
    return made


def recheck(state: State, corpus: DataFrame, folder: str, resolver: Resolver = resolve) -> dict:
    """Decides every stored result anew, without the stored decisions and stop rules; the state stays as
    it is. Every page must parse before anything is written."""
    parsed = payloads.parsed(state.table("pages"))
    bad = parsed.filter("problem is not null").select("problem").first()
    if bad is not None:
        raise ValueError(bad["problem"])
    results = parsed.select("query", F.explode("results").alias("r")).select("query", F.col("r.url").alias("url")).distinct()
    before = state.table("resolutions")
    after = resolver(results, corpus)
    untouched = before.join(after.select("query", "discovered_url"), ["query", "discovered_url"], "left_anti")
    return recheck_files(before, untouched.unionByName(after), folder)


def export_state(state: State, folder: str, interrupted: bool = False) -> dict:
    return export(state.table("resolutions"), state.table("progress"), folder, {"config": state.meta()["config"]}, interrupted)


def audit_state(state: State, folder: str, size: int = 20, seed: int = 42, reclassify: bool = False) -> dict:
    from ..operators.audit import search_details

    rows = payloads.exploded(payloads.parsed(state.table("pages")))
    return audit_bundle(state.table("resolutions"), search_details(rows), state.table("progress"), folder, size, seed, reclassify)
