"""Cutting lineage, ranks over whole tables and membership filters of bounded size."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a membership filter: 64 MB. Beyond its capacity it lets more through, never less.
FILTER_BITS = 1 << 29
#: Most rows of a broadcast side: some tens of bytes each.
SMALL_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where neither the session nor the
    context names one, a folder is made if the whole of Spark runs in this one process; a cluster is refused."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoints")


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def row_key(id: str, text: str) -> Column:
    """What tells rows apart: id and text. Rows equal in both are alike in all that depends on them. Null ids
    come behind the others."""
    column = F.col(id).cast("long")
    return F.struct(column.isNull().alias("none"), column.alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text"))


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(frame: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The frame, written, as the side of a join: to be broadcast if it has at most `most` rows (they
    must be short), to be shuffled beyond that. The other side then stays where it is, with its texts."""
    written = checkpointed(frame)
    return F.broadcast(written) if written.count() <= most else written


def ranked(frame: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """The frame with a global row number (from 0) in the given order, without a single sorting task:
    ranges are sorted apart, written, counted, and offset by the rows of the ranges before. What comes
    to the driver is one number per range."""
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = checkpointed(frame.repartitionByRange(n, *order).sortWithinPartitions(*order))
    numbered = part.withColumn("_part", F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = dict(part.groupBy(F.spark_partition_id().alias("p")).count().collect())
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.lit(before) if before else F.array(F.lit(0)), F.col("_part") + 1)
    return numbered.withColumn(name, F.col(name) + offset.cast("long")).drop("_part")


def membership(keys: DataFrame, column: str) -> Broadcast:
    """A Bloom filter (two probes) of a long column that is already a good hash, made by one grouped
    aggregation; what comes to the driver is at most FILTER_BITS bits, for any number of keys."""
    n = keys.count()
    bits = 1 << 16
    while bits < 64 * n and bits < FILTER_BITS:
        bits *= 2
    key = F.col(column)
    probes = F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 29).bitwiseAND(bits - 1)))
    set_bits = keys.select(probes.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    table = np.zeros(bits // 64, dtype=np.int64)
    got = set_bits.toArrow()
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the filter; False is certain."""
    last = np.uint64(len(table) * 64 - 1)
    found = np.ones(keys.shape, dtype=bool)
    for probe in (keys & last, (keys >> np.uint64(29)) & last):
        found &= (table[probe >> np.uint64(6)] >> (probe & np.uint64(63))) & np.uint64(1) == 1
    return found


