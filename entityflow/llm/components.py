"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import checkpointed


def _written(edges: DataFrame) -> DataFrame:
    """The edges, checkpointed, as a table of unknown size. A checkpoint keeps the size that the plan foretells, and that of
    a join is the product of its sides: its digits double with each step, until they fill the driver's memory."""
    rows = checkpointed(edges)._jdf
    return DataFrame(edges.sparkSession._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), edges.sparkSession)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = _written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least")))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = _written(down.groupBy("src").agg(F.min("dst").alias("least")))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst")
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each src (above its dst) has one dst, and no dst is a src: then dst is the least of its component."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").head(1)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src > dst) with the same components as edges after one round of both steps: already stars where
    components are small in diameter. Each src has one or more dst."""
    # written first: the steps read their edges many times, and each reading is a copy of the plan
    return _written(_small_star(_written(_large_star(_written(edges.select("src", "dst").filter("src <> dst").distinct())))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; edges has columns src and dst of one orderable
    type, in any direction, repeated or not. component is the smallest node that can be reached.

    Each step joins edges with one minimum per node. The minima are written first, so that the join deals
    both sides itself and a node of very many edges is split by the skewed-join rule rather than gathered. Steps are
    checkpointed; the loop ends when all edges are stars, which both steps would leave as they are. Edges with a null
    end and loops are left out; no edges give no rows.
    """
    now = _written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while not _stars(now):
        now = _written(_small_star(_written(_large_star(now))))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
