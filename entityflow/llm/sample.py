"""Bounded samples of labelled texts for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, most: int, most_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of the `most` labelled ids of the least MD5, as far as most_bytes of text reach.

    docs has _id and the text column, labels _id and _y; rows with a null in any of these are left out.
    At most `most` rows of sizes and most_bytes of text come to the driver; an id whose texts do not
    fit is passed over. The order is that of the id's spelling, so the result is the same each time.
    """
    chosen = labels.filter("_id is not null and _y is not null").distinct().orderBy(F.md5(F.col("_id").cast("string")), "_id", "_y").limit(most)
    return _texts(docs, chosen, text, most_bytes, {})


def stratified_sample(docs: DataFrame, labels: DataFrame, text: str, most: int, most_bytes: int, least: int) -> list[tuple[str, object]]:
    """(text, label) as of labelled_sample(), but with the same number of ids of each label, as far as it
    has so many: whatever its share of the rows, a label with `least` ids is in the sample.

    Counts are of all rows. Labels of fewer than `least` ids, and of those beyond most / least labels the
    rarest, are left out. Ids stand in the order of their place within their label, so most_bytes cuts all
    labels alike. A label's ids are drawn by the MD5 of the id under a threshold that its count gives, so
    some 2 * most small rows and 100 more of each label come to the driver.
    """
    known = labels.filter("_id is not null and _y is not null")
    counts = sorted(((r["count"], r["_y"]) for r in known.distinct().groupBy("_y").count().filter(F.col("count") >= least).collect()), key=lambda x: (-x[0], x[1]))[: most // least]
    if not counts:
        return []
    share, left = 0, most  # fill all labels to one level
    for k, (n, _) in enumerate(reversed(counts)):
        share = left // (len(counts) - k)
        left -= min(n, share)
    # the first 32 bits of the MD5; so much over the share that fewer ids than it are as good as impossible
    draw = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 8), 16, 10).cast("long")
    limits = docs.sparkSession.createDataFrame([(y, int(min(1.0, (share + 10 * share**0.5 + 50) / n) * 2**32)) for n, y in counts], labels.select(F.col("_y").alias("_label")).schema.add("_limit", "long"))
    near = known.join(F.broadcast(limits), F.col("_y") == F.col("_label")).filter(draw < F.col("_limit")).select("_id", "_y", F.md5(F.col("_id").cast("string")).alias("draw")).distinct().collect()
    by_label: dict[object, list] = {}
    for r in sorted(near, key=lambda r: (r["draw"], str(r["_id"]))):
        by_label.setdefault(r["_y"], []).append(r["_id"])
    ranked = sorted(((k, y, x) for y, ids in by_label.items() for k, x in enumerate(ids[:share])), key=lambda z: z[:2])[:most]
    places: dict[object, int] = {}
    for k, _, x in ranked:
        places.setdefault(x, k)
    chosen = docs.sparkSession.createDataFrame([(x, y) for _, y, x in ranked], labels.select("_id", "_y").schema)
    return _texts(docs, chosen, text, most_bytes, places)


def _texts(docs: DataFrame, chosen: DataFrame, text: str, most_bytes: int, places: dict) -> list[tuple[str, object]]:
    """(text, label) of the chosen ids, in the order of places, then MD5, as far as most_bytes reach."""
    rows = docs.select("_id", F.col(text).cast("string").alias("_text")).filter("_text is not null")
    sizes = rows.join(F.broadcast(chosen.select("_id").distinct()), "_id").groupBy("_id").agg(F.sum(F.octet_length("_text")).alias("n"))
    taken, size = [], 0
    for r in sorted(sizes.withColumn("draw", F.md5(F.col("_id").cast("string"))).collect(), key=lambda r: (places.get(r["_id"], 0), r["draw"], str(r["_id"]))):
        if size + r["n"] <= most_bytes:
            taken.append(r["_id"])
            size += r["n"]
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame([(x,) for x in taken], chosen.select("_id").schema)
    got = rows.join(F.broadcast(chosen.join(F.broadcast(wanted), "_id")), "_id").collect()
    return [(t, y) for _, t, y in sorted((str(r["_id"]), r["_text"], r["_y"]) for r in got)]
