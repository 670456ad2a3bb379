"""Language identification by Bayesian evidence fusion (operator 1).

Four kinds of evidence meet in one posterior per row: the likelihood of the text's byte trigrams, the
language that the markup declares, and a prior of the address: counts of the host, smoothed by those of
its suffix, smoothed by those of all rows. Counts come from grouped aggregation over all rows, and a
row's own text never counts towards its own prior. `und` (undetermined) stands for text that is like
none of the languages: its trigrams are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityflow.shipping import map_arrow

from . import words as W
from .sample import stratified_sample
from .store import checkpointed, small_side

#: Most labelled rows, and bytes of their text, that the trigram counts are fitted on.
MOST_TRAINING = 2000
MOST_TRAINING_BYTES = 8 << 20
#: Texts that a language must have, in the whole corpus, to be learned.
LEAST_TEXTS = 5
BUCKETS = 1 << 15
#: Most hosts whose counts are broadcast (some 200 bytes each); more are shuffled.
MOST_HOSTS = 100_000
UNDETERMINED = "und"
#: Text counts as this many independent trigrams at most: neighbours are far from independent.
MOST_EVIDENCE = 120.0
#: Pseudo-counts: of a trigram, of the suffix behind a host, of all rows behind a suffix, of a declaration.
SMOOTH, HOST_PRIOR, SUFFIX_PRIOR, DECLARED_PRIOR = 0.2, 20.0, 50.0, 5.0
_FOLD = np.full(256, 0x20, dtype=np.uint8)  # anything but letters is a space
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


class Model(NamedTuple):
    """languages, the last one undetermined; logs: log-likelihood of each bucket (down) and language."""

    languages: list[str]
    logs: np.ndarray


def trigrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of each byte trigram with a letter in its middle (other bytes are spaces), in
    windows of W.WINDOW bytes: what is held does not grow with the column or with a long text."""
    data, offsets = W.buffers(column)
    for at in range(0, len(data) - 2, W.WINDOW):
        x = _FOLD[data[at : at + W.WINDOW + 2]]
        middle = np.flatnonzero(x[1:-1] != 0x20)
        row = np.searchsorted(offsets, middle + at, side="right") - 1
        inside = middle + at + 3 <= offsets[row + 1]
        middle, row = middle[inside].astype(np.int32), row[inside].astype(np.int32)
        code = x[middle].astype(np.uint64)
        for k in (1, 2):
            code <<= np.uint64(8)
            code |= x[middle + k]
        del inside, middle
        yield row, (W.mix(code) & np.uint64(BUCKETS - 1)).astype(np.int32)


def fit(texts: list[str], languages: list[str], least: int = LEAST_TEXTS) -> Model:
    """Trigram frequencies of every language with at least `least` texts."""
    names = sorted(x for x in set(languages) if languages.count(x) >= least)
    logs = np.full((BUCKETS, len(names) + 1), -np.log(BUCKETS))
    for k, name in enumerate(names):
        counts = np.full(BUCKETS, SMOOTH)
        for _, bucket in trigrams(pa.array([t for t, y in zip(texts, languages, strict=True) if y == name], pa.string())):
            counts += np.bincount(bucket, minlength=BUCKETS)
        logs[:, k] = np.log(counts / counts.sum())
    return Model([*names, UNDETERMINED], logs)


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, lower case; empty for null or anything else."""
    return F.lower(F.regexp_extract(F.coalesce(tag.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang", most: int = MOST_TRAINING, most_bytes: int = MOST_TRAINING_BYTES) -> Model:
    """The model of a bounded sample of rows whose language is declared: as many rows of each language as of
    any other, if it has them, so that rare languages are learned whatever the size of the corpus. Of more
    than most / LEAST_TEXTS languages the rarest are left out."""
    tags = docs.select(F.col(id).alias("_id"), primary(F.col(language)).alias("_y")).filter("_y <> ''")
    got = stratified_sample(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), tags, "_text", most, most_bytes, LEAST_TEXTS)
    return fit([t for t, _ in got], [y for _, y in got])


def log_likelihoods(model: Model, column: pa.Array) -> np.ndarray:
    """Per row and language, weakened to MOST_EVIDENCE trigrams; 0 without letters."""
    n, k = len(column), len(model.languages)
    count, total = np.zeros(n), np.zeros((n, k))
    for row, bucket in trigrams(column):
        count += np.bincount(row, minlength=n)
        for i in range(k):
            total[:, i] += np.bincount(row, model.logs[bucket, i], n)
    return total * np.minimum(1.0, MOST_EVIDENCE / np.maximum(count, 1))[:, None]


def _scored(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """rows with _logs (per language), null where there is no letter."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, text):
                logs = log_likelihoods(sent.value, batch.column(text))
                k = logs.shape[1]
                none = ~logs.any(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, k), pa.int32()), pa.array(logs.reshape(-1)))
                column = pa.array([None]).cast(lists.type).take(pa.array(np.zeros(len(none), dtype=np.int64))) if none.all() else lists.take(pa.array(np.arange(len(none)), mask=none))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_logs"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("_logs", T.ArrayType(T.DoubleType()))]))


def suffix_of(host: Column) -> Column:
    """The last label of an address; a name without a dot has none."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def identify(rows: DataFrame, model: Model, text: Column, declared: Column, host: Column, least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """rows, all columns (or those in keep), with _language, _probability and _accepted.

    Accepted is a row whose most probable language is not undetermined and has at least the probability
    `least`. Null or empty texts, or texts without letters, give no text evidence: they are judged by
    their declaration and address, and are not accepted without a declared language of the model. A null
    or strange declaration says nothing; a null host is the host of that name. Ties go to the language
    that is first in the alphabet. Repeated rows are judged alike; no rows give no rows. Columns of the
    names used here (_language and the like) are replaced.
    """
    names = model.languages
    n = len(names)
    tagged = rows.withColumns({"_text": F.coalesce(text.cast("string"), F.lit("")), "_declared": primary(declared), "_host": F.lower(F.coalesce(host.cast("string"), F.lit("")))})
    if keep is not None:
        tagged = tagged.select(*keep, "_text", "_declared", "_host")
    scored = _scored(tagged, model, "_text").drop("_text")
    if keep is not None:  # without the text, rows are small: they are written once instead of scored twice
        scored = checkpointed(scored)
    guess = F.array_position(F.col("_logs"), F.array_max(F.col("_logs")))
    scored = scored.withColumn("_guess", F.coalesce(guess.cast("int"), F.lit(0)))
    cells = checkpointed(scored.groupBy("_host", "_declared", "_guess").count())  # all that is counted, in one pass
    one = [F.sum(F.when(F.col("_guess") == k + 1, F.col("count")).otherwise(0)).alias(f"c{k}") for k in range(n)]
    more = [F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]
    array = lambda prefix="c": F.array(*(F.col(f"{prefix}{k}") for k in range(n)))
    by_host = cells.groupBy("_host").agg(*one)
    by_suffix = by_host.groupBy(suffix_of(F.col("_host")).alias("_suffix")).agg(*more)
    root = by_suffix.agg(*more).first()
    base = np.array([float(root[k] or 0) for k in range(n)]) + 1
    base /= base.sum()
    said_so = cells.filter(F.col("_declared").isin(names) & (F.col("_guess") > 0)).groupBy("_declared", "_guess").agg(F.sum("count").alias("n"))
    tags = {(r["_declared"], r["_guess"]): r["n"] for r in said_so.collect()}  # languages squared
    said = {}
    for k in range(n):  # chance of each declaration given the language, as the text alone tells it
        total = sum(tags.get((x, k + 1), 0) for x in names)
        for d in names:
            said[d, k] = float(np.log((tags.get((d, k + 1), 0) + DECLARED_PRIOR * (0.8 if d == names[k] else 0.2 / max(n - 1, 1))) / (total + DECLARED_PRIOR)))
    host_counts = by_host.select("_host", array().alias("_hc"))
    suffix_counts = by_suffix.select("_suffix", array().alias("_sc"))
    counts = host_counts.withColumn("_suffix", suffix_of(F.col("_host"))).join(suffix_counts, "_suffix").select("_host", "_hc", "_sc")
    joined = scored.join(small_side(counts, MOST_HOSTS), "_host")
    own = lambda k: F.when(F.col("_guess") == k + 1, 1.0).otherwise(0.0)
    mine = F.when(F.col("_guess") > 0, 1.0).otherwise(0.0)
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, x: s + x)
    joined = joined.withColumns({"_hn": total("_hc") - mine, "_sn": total("_sc") - mine})
    place = F.when(F.col("_declared") != UNDETERMINED, F.array_position(F.lit(names), F.col("_declared")).cast("int")).otherwise(0)
    parts = []
    for k in range(n):
        suffix = (F.element_at("_sc", k + 1) - own(k) + SUFFIX_PRIOR * float(base[k])) / (F.col("_sn") + SUFFIX_PRIOR)
        prior = (F.element_at("_hc", k + 1) - own(k) + HOST_PRIOR * suffix) / (F.col("_hn") + HOST_PRIOR)
        tag = F.when(place > 0, F.element_at(F.lit([said[d, k] for d in names]), place)).otherwise(0.0)
        parts.append(F.log(prior) + tag + F.coalesce(F.element_at("_logs", k + 1), F.lit(0.0)))
    joined = joined.withColumn("_sum", F.transform(F.array(*parts), lambda x: x))
    best = F.array_max("_sum")
    language = F.element_at(F.lit(names), F.array_position("_sum", best).cast("int"))
    sure = 1 / F.aggregate("_sum", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    out = joined.withColumns({"_language": language, "_probability": sure})
    known = F.col("_logs").isNotNull() | F.col("_declared").isin(names[:-1])
    return out.withColumn("_accepted", (F.col("_language") != UNDETERMINED) & (F.col("_probability") >= least) & known).drop("_declared", "_host", "_logs", "_guess", "_hc", "_sc", "_hn", "_sn", "_sum")


def visible_text(html: Column) -> Column:
    """The page's text: without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*)""", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
