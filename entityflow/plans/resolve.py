"""Decisions for many results at once: every stored page is read once, and a result meets the few pages
that it can lead to by bounded rounds of equality joins. No group is larger than the inspection budget
allows, however many results one host has."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import written
from ..shipping import map_arrow
from . import pages as P
from .decide import MOST_INSPECTED, decide


def to_record(page: P.Page) -> str:
    row = page._asdict() | {"signals": [list(s) for s in page.signals], "kinds": sorted(page.kinds)}
    return json.dumps(row, ensure_ascii=False)


def from_record(record: str) -> P.Page:
    row = json.loads(record)
    signals = tuple(P.Signal(c, n, tuple(a)) for c, n, a in row["signals"])
    return P.Page(**row | {"signals": signals, "candidates": tuple(map(tuple, row["candidates"])), "homes": tuple(row["homes"]), "abouts": tuple(row["abouts"]), "kinds": frozenset(row["kinds"])})


def page_records(corpus: DataFrame) -> DataFrame:
    """corpus (url, final_url, status, content_type, html) -> url (normalized), record. Rows whose url or
    final url is not valid are failed pages; one row per url is kept, the one of the least record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, records = [], []
            for row in batch.to_pylist():
                url = P.normalize(row["url"] or "")
                if url is None:
                    continue
                final = P.normalize(row["final_url"] or url)
                page = P.Page(url, "invalid_url") if final is None else P.read_page(final, row["status"] or 0, (row["content_type"] or "").split(";")[0].strip().lower(), row["html"] or "")
                urls.append(url)
                records.append(to_record(page))
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(records, pa.string())], ["url", "record"])

    read = corpus.select("url", "final_url", F.col("status").cast("int").alias("status"), "content_type", "html")
    return map_arrow(read, run, "url string, record string").groupBy("url").agg(F.min("record").alias("record"))


def _wanted(url: str, known: dict[str, P.Page], step: int) -> list[str]:
    original = P.normalize(url)
    if original is None:
        return []
    if step == 0:
        return [original]
    source = known.get(original)
    place = source.url if source and not source.error else original
    if step == 1:
        homes = [u for _, u in source.candidates[:1]] + list(source.homes) if source else []
        root = "/".join(place.split("/")[:3]) + "/"
        return [*homes[: MOST_INSPECTED + 1], root]
    return [a for page in known.values() for a in page.abouts[: MOST_INSPECTED + 1] if not page.error]


def _step(state: DataFrame, records: DataFrame, step: int) -> DataFrame:
    """state (url, known) with the pages that are wanted next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                known = {k: from_record(v) for k, v in (row["known"] or [])}
                out.append(sorted(set(_wanted(row["url"] or "", known, step)) - known.keys()))
            yield pa.RecordBatch.from_arrays([batch.column("url"), batch.column("known"), pa.array(out, pa.list_(pa.string()))], ["url", "known", "wanted"])

    asked = map_arrow(state, run, "url string, known map<string,string>, wanted array<string>")
    found = asked.select("url", F.explode("wanted").alias("at")).join(records.withColumnRenamed("url", "at"), "at")
    grouped = found.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("at", "record"))).alias("more"))  # a few pages by _wanted
    return state.join(grouped, "url", "left").select("url", F.when(F.col("more").isNull(), F.col("known")).otherwise(F.map_concat("known", "more")).alias("known"))


DECISION = "status string, name string, url string, reason string, evidence string"


def resolve(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """results (query, url) -> query, discovered_url, status, name, url, reason, evidence.

    Equal URLs are decided once. Pages that the corpus lacks fail as not_available_in_fixture; null and
    malformed URLs are pending/invalid_url.
    """
    records = written(page_records(corpus))
    state = results.select(F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("known", F.create_map().cast("map<string,string>"))
    for step in range(3):
        state = written(_step(state, records, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tuple(decide(r["url"], {k: from_record(v) for k, v in (r["known"] or [])}.get)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("url"), *(pa.array([r[i] for r in rows], pa.string()) for i in range(5))], ["discovered_url", "status", "name", "url", "reason", "evidence"])

    decided = map_arrow(state, run, f"discovered_url string, {DECISION}")
    return results.select("query", F.coalesce("url", F.lit("")).alias("discovered_url")).distinct().join(decided, "discovered_url").select("query", "discovered_url", "status", "name", "url", "reason", "evidence")
