"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def written(frame: DataFrame) -> DataFrame:
    """The frame, checkpointed to the folder in spark.checkpoint.dir. Where neither the session nor the context
    names one, a folder is made if the whole of Spark runs in this one process; a cluster is refused."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return frame.checkpoint()
