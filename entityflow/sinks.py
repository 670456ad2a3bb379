"""Files for people and other programs: one named file each, replaced whole. Rows stream through the
driver in order (toLocalIterator), a partition at a time; everything is checked before the first write."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import traceback
import zipfile
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audit, selection


class OutputError(ValueError):
    """The message is the machine-readable reason."""


def _replace(path: Path, parts: Iterable[bytes]) -> None:
    temporary = path.with_name(f".{path.name}.part")
    with temporary.open("wb") as out:
        out.writelines(parts)
    os.replace(temporary, path)


def csv_parts(rows: Iterable, header: list[str]) -> Iterable[bytes]:
    """UTF-8 with a byte order mark, semicolons, minimal quotes, CR LF."""
    yield b"\xef\xbb\xbf"
    buffer = io.StringIO(newline="")
    writer = csv.writer(buffer, delimiter=";", lineterminator="\r\n")
    writer.writerow(header)
    for row in rows:
        writer.writerow([row[c] for c in header])
        if buffer.tell() > 1 << 16:
            yield buffer.getvalue().encode()
            buffer.seek(0)
            buffer.truncate()
    yield buffer.getvalue().encode()


def json_array(rows: Iterable) -> Iterable[bytes]:
    yield b"["
    for i, row in enumerate(rows):
        yield (",\n" if i else "\n").encode() + json.dumps(row.asDict(recursive=True), ensure_ascii=False).encode()
    yield b"\n]\n"


def guarded(folder: str, forbidden: Path) -> Path:
    """The output folder; refuses places inside a checkout or the package."""
    path = Path(folder).resolve()
    if path == forbidden or forbidden in path.parents:
        raise OutputError("output_inside_checkout")
    path.mkdir(parents=True, exist_ok=True)
    return path


def export(resolutions: DataFrame, progress: DataFrame, folder: str, metadata: dict | None = None, interrupted: bool = False) -> dict:
    """companies.csv, pending.json, report.json, handoff.json and handoff.metadata.json; the report."""
    path = guarded(folder, Path(__file__).resolve().parent.parent)
    order = ["query", "discovered_url"]
    bad = resolutions.filter("status = 'confirmed' and (name is null or trim(name) = '')").limit(1).count()
    chosen = selection.sites(resolutions)
    if bad or selection.collisions(chosen).limit(1).count():
        raise OutputError("handoff_collision")
    statuses = {r["status"]: r["n"] for r in audit.tallies(resolutions, "status").collect()}
    n_sites = chosen.select("site_name").distinct().count()
    pending = statuses.get("pending", 0)
    flags = selection.completeness(progress, pending, interrupted).first().asDict()
    state = progress.select("query", F.col("status").alias("query_status"))
    lineage = chosen.join(resolutions.select(*order, "evidence"), order).join(state, "query", "left").withColumn("query_status", F.coalesce("query_status", F.lit("unknown")))
    sources = lineage.groupBy("site_name", "site_url").agg(F.array_sort(F.collect_list(F.struct("query", "discovered_url", "name", "url", "query_status", "evidence"))).alias("sources"))
    others = selection.alternatives(chosen).groupBy("site_name").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "url"))).alias("alternatives"))
    founders = chosen.groupBy("site_name").agg(F.min(F.struct(*order)).alias("at"))
    handoff = sources.join(others, "site_name", "left").join(founders, "site_name").orderBy("at").drop("at")
    rows = selection.companies(resolutions)
    report = (metadata or {}) | {"exported_rows": rows.count(), "counts": statuses, **flags}
    _replace(path / "handoff.json", json_array(handoff.toLocalIterator()))
    _replace(path / "handoff.metadata.json", [json.dumps({"sites": n_sites, "confirmed": statuses.get("confirmed", 0), "duplicates": statuses.get("confirmed", 0) - n_sites, "pending": pending, "skipped": statuses.get("skipped", 0), **flags}, ensure_ascii=False).encode()])
    _replace(path / "companies.csv", csv_parts(rows.orderBy("SearchQuery", "discovered_url").toLocalIterator(), ["CompanyName", "URL", "SearchQuery"]))
    _replace(path / "pending.json", json_array(resolutions.filter("status <> 'confirmed'").orderBy(*order).toLocalIterator()))
    _replace(path / "report.json", [json.dumps(report, ensure_ascii=False).encode()])
    return report


AUDIT_COLUMNS = "CaseID Reason SourceURL Host Queries SearchTitles SearchSnippets StoredStatuses UpdatedStatuses ReviewOutcome ReviewerNotes".split()


def audit_bundle(resolutions: DataFrame, details: DataFrame, progress: DataFrame, folder: str, size: int = 20, seed: int = 42, reclassify: bool = False) -> dict:
    """audit_cases.csv, audit_summary.json, the five exports and audit_bundle.zip of all seven. An output
    folder that exists is refused."""
    if Path(folder).exists():
        raise OutputError("output_exists")
    updated = audit.reclassified(resolutions) if reclassify else resolutions
    picked = audit.sampled(audit.cases(resolutions), size, seed)
    seen = details.groupBy("url").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("snippets")))).alias("s"))
    status = lambda frame, name: frame.groupBy(F.col("discovered_url").alias("url"), "reason").agg(F.array_sort(F.collect_set("status")).alias(name))
    none = F.array().cast("array<string>")
    rows = picked.join(seen, "url", "left").join(status(resolutions, "a"), ["url", "reason"], "left").join(status(updated, "b"), ["url", "reason"], "left").orderBy("reason", "place")
    shown = rows.select(F.col("case_id").alias("CaseID"), F.col("reason").alias("Reason"), F.col("url").alias("SourceURL"), F.col("host").alias("Host"), *(F.to_json(F.coalesce(c, none)).alias(n) for c, n in (("queries", "Queries"), ("t", "SearchTitles"), ("s", "SearchSnippets"), ("a", "StoredStatuses"), ("b", "UpdatedStatuses"))), F.lit("").alias("ReviewOutcome"), F.lit("").alias("ReviewerNotes"))
    export(updated, progress, folder)
    path = Path(folder).resolve()
    by = lambda frame: {r["status"]: r["n"] for r in audit.tallies(frame, "status").collect()}
    summary = {"cases": picked.count(), "before": by(resolutions), "after": by(updated), "reclassified": resolutions.filter("status = 'pending'").count() - updated.filter("status = 'pending'").count()}
    _replace(path / "audit_cases.csv", csv_parts(shown.toLocalIterator(), AUDIT_COLUMNS))
    _replace(path / "audit_summary.json", [json.dumps(summary, ensure_ascii=False).encode()])
    with zipfile.ZipFile(path / "audit_bundle.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for name in "audit_summary.json audit_cases.csv report.json companies.csv pending.json handoff.metadata.json handoff.json".split():
            out.write(path / name, name)
    return summary


def recheck_files(before: DataFrame, after: DataFrame, folder: str) -> dict:
    """recheck_changes.json and recheck_summary.json."""
    path = guarded(folder, Path(__file__).resolve().parent.parent)
    changed = audit.changes(before, after).orderBy("query", "discovered_url")
    by = lambda frame: {r["status"]: r["n"] for r in audit.tallies(frame, "status").collect()}
    summary = {"before": by(before), "after": by(after), "changed": changed.count()}
    _replace(path / "recheck_changes.json", json_array(changed.toLocalIterator()))
    _replace(path / "recheck_summary.json", [json.dumps(summary).encode()])
    return summary


def worker_error(error: BaseException, folder: str, query: str, url: str, phase: str) -> dict:
    """worker_error.json: where a worker failed, without messages, source lines, values or the url's query."""
    path = guarded(folder, Path(__file__).resolve().parent.parent)
    parts = urlsplit(url if "://" in url else "")
    clean = lambda x: re.sub(r"[^\x20-\x7e\xa0-\uffff]", " ", re.sub(r"apify_api_[A-Za-z0-9_-]+", "[redacted]", x))[:500]
    details = {
        "captured_at": datetime.now(UTC).isoformat(), "query": clean(query), "source_location": clean(f"{parts.scheme}://{parts.netloc.rpartition('@')[2]}{parts.path}") if parts.netloc else "[invalid URL]",
        "source_url_sha256": hashlib.sha256(url.encode("utf-8", "replace")).hexdigest(), "phase": phase, "exception_type": clean(type(error).__name__),
        "frames": [{"file": clean(Path(f.filename).name), "line": f.lineno, "function": clean(f.name)} for f in traceback.extract_tb(error.__traceback__)[-12:]],
    }
    _replace(path / "worker_error.json", [json.dumps(details, indent=2).encode()])
    return details
