"""Mixing sources to target weights by systematic sampling (operator 10)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ranked

#: Offsets tried in a source: a random one (from the MD5 of its name) and its shifts by equal parts of 1.
OFFSETS = 32
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _water_level(sources: DataFrame, most: int) -> tuple[int, int]:
    """The level as a fraction (rest, weight): a source of weight w gets min(most * size, rest * w /
    weight), which sums to all sizes. Each step is one aggregate of one row; the level only rises, by
    the sources that reached their cap."""
    total, weight = (int(x or 0) for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    level = (total, weight)
    while level[1]:
        rest, w = level
        full = F.col("source_size").cast("decimal(38,0)") * most * F.lit(w).cast("decimal(20,0)") <= F.lit(rest).cast("decimal(20,0)") * F.col("weight").cast("decimal(10,0)")
        got = sources.filter(full).agg(F.sum("source_size"), F.sum("weight")).first()
        new = (total - most * int(got[0] or 0), weight - int(got[1] or 0))
        if new[1] == 0 or Fraction(*new) == Fraction(*level):
            break
        level = new
    return level


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words; the sources, in code-point order with null last, have `weights` in
    turn and share 100 % of all sizes by them; a target stops at `most` times its source's size and the
    excess goes to the others by weight until none is above. Within a source every document expects
    target / source_size copies. Documents stand in the random order of their id's MD5; their expected copies are
    summed along it, one offset per source is added, and a document is emitted once per integer boundary
    that its interval crosses. The offset is random (from the MD5 of the source's name, so reruns agree),
    shifted by that one of OFFSETS equal parts that brings the taken words nearest to the target: few or
    very uneven documents would else miss it by up to the longest of them.

    Null and empty texts have size 0 and take nothing; a null id sorts first; null is a source of its
    own; repeated rows are rows of their own; no rows give no rows. The sum along a source is a rank in
    a range-sorted table, so a source with a third of all rows is spread over many tasks.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    rows = rows.withColumn("_draw", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12))
    placed = ranked(rows, F.col("source").asc_nulls_last(), F.col("_draw").asc(), F.col("doc_id").asc(), F.col("size").asc(), name="_rank")
    found = placed.groupBy("source").agg(F.min("_rank").alias("_first"), F.sum("size").alias("source_size"))
    turn = F.element_at(F.lit(list(weights)), (F.col("_turn") % len(weights) + 1).cast("int"))
    sources = ranked(found, F.col("source").asc_nulls_last(), name="_turn").withColumn("weight", turn)
    rest, weight = _water_level(sources, most)
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1)))
    target = F.least(share, F.col("source_size").cast("double") * most)
    start = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("\0"))), 1, 5), 16, 10).cast("double") / float(1 << 20)
    shares = sources.select(F.col("source").alias("_source"), "_first", "source_size", target.alias("target"), start.alias("_start"))
    with_share = placed.join(shares, placed["source"].eqNullSafe(shares["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = (F.col("_rank") - F.col("_first")).cast("double")

    def copies(offset: Column) -> Column:
        return F.floor((place + 1) * rate + offset) - F.floor(place * rate + offset)

    tried = [(F.col("_start") + j / OFFSETS) - F.floor(F.col("_start") + j / OFFSETS) for j in range(OFFSETS)]
    sums = with_share.groupBy("_source").agg(F.first("_start").alias("_start"), F.first("target").alias("target"), *(F.sum(F.col("size") * copies(u)).alias(f"_t{j}") for j, u in enumerate(tried)))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_t{j}").cast("double") - F.col("target")).alias("off"), F.lit(j).alias("j"), u.alias("offset")) for j, u in enumerate(tried))))
    offsets = sums.select(F.col("_source").alias("_source2"), nearest["offset"].alias("_offset"))
    drawn = with_share.join(offsets, with_share["_source"].eqNullSafe(offsets["_source2"]))
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies(F.col("_offset")).alias("copies"), (F.col("size") * copies(F.col("_offset"))).alias("taken"))
