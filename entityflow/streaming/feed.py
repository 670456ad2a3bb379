"""Incremental runs: payload files as a stream, decisions per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.runs import discover
from ..state import SCHEMAS, State


def follow(spark: SparkSession, folder: str, state: State, corpus: DataFrame, checkpoint: str, max_pages: int = 3) -> StreamingQuery:
    """Reads new JSON files (query, start, payload) of a folder, stores their pages and decides what is
    new. A batch that is delivered again changes nothing: pages are upserted, stored decisions are not
    made again. Ends when what is there has been read."""

    def accept(batch: DataFrame, _: int) -> None:
        state.upsert(pages=batch.dropDuplicates(["query", "start"]))
        discover(state, corpus, max_pages)

    stream = spark.readStream.schema(SCHEMAS["pages"]).json(folder)
    return stream.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
