"""Batches of queries within a page budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class BudgetExceeded(ValueError):
    """The message is the machine-readable reason."""


def batch_plan(queries: DataFrame, pages: DataFrame, reserved: int, max_pages_total: int, depth: int, size: int) -> DataFrame:
    """queries (query, pos), pages (query) -> query, rn, batch, reserve: the queries without pages, in
    order, as far as the budget reaches, in batches of `size`.

    The order is a single list by nature (the queries of one run, which the caller typed), so one task
    numbers it; the anti-join before it is distributed.
    """
    allowed = max(0, (max_pages_total - reserved) // depth)
    waiting = queries.join(pages.select("query").distinct(), "query", "left_anti")
    numbered = waiting.withColumn("rn", F.row_number().over(Window.orderBy("pos")).cast("long")).filter(F.col("rn") <= allowed)
    return numbered.select("query", "rn", F.floor((F.col("rn") - 1) / size).cast("long").alias("batch"), F.lit(depth).cast("long").alias("reserve"))


def reserved_pages(batches: DataFrame) -> int:
    """Pages reserved so far; abandoned batches count too."""
    return int(batches.agg(F.coalesce(F.sum("reserved_pages"), F.lit(0))).first()[0])


def reserve(batches: DataFrame, new: int, limit: int) -> int:
    """The total after reserving `new` more pages; refuses to pass the limit."""
    total = reserved_pages(batches) + new
    if total > limit:
        raise BudgetExceeded("apify_page_limit")
    return total


#: status -> what may follow it
TRANSITIONS = {"planned": {"running", "abandoned"}, "running": {"running", "done", "abandoned"}, "done": set(), "abandoned": set()}


def running_reservations(batches: DataFrame, limit: int, run: str) -> DataFrame:
    """batches (run, id, reserved_pages) with reserved (the total up to each batch of its run) and exceeded."""
    total = F.sum("reserved_pages").over(Window.partitionBy(run).orderBy("id"))
    return batches.withColumns({"reserved": total, "exceeded": total > limit})


def moved(batches: DataFrame, batch: int | Column, status: str, run_id: str | None = None) -> DataFrame:
    """batches with one batch (or those of a condition) in a new state; a step that TRANSITIONS does not
    have fails the job."""
    here = batch if isinstance(batch, Column) else F.col("id") == batch
    before = [old for old, new in TRANSITIONS.items() if status in new]
    checked = F.when(F.col("status").isin(before), F.lit(status)).otherwise(F.raise_error(F.concat(F.lit("batch_transition: "), F.col("status"), F.lit(f" -> {status}"))).cast("string"))
    out = batches.withColumn("status", F.when(here, checked).otherwise(F.col("status")))
    return out if run_id is None else out.withColumn("run_id", F.when(here, F.lit(run_id)).otherwise(F.col("run_id")))


def open_batch(batches: DataFrame) -> DataFrame:
    """The first batch that is planned or running."""
    return batches.filter(F.col("status").isin("planned", "running")).orderBy("id").limit(1)
