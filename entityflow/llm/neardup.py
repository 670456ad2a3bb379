"""Near-duplicate classes of texts: MinHash banding, verification on full sets, components.

1. Every text gets its set of distinct word shingles, a 128-bit fingerprint of that set and the keys
   of its MinHash bands (`sketched`). Texts of equal sets are one node of the graph.
2. One minimum and maximum per band key tells which keys hold more than one node. A Bloom filter of
   these keys (bounded size) selects the nodes that have any partner; only those move with text.
3. Each node is paired with the least node of each of its keys (a star, linear in the bucket), pairs
   are tested on signatures, then on full sets, and linked nodes get a common label (one round of stars).
4. Where a bucket still holds several labels, its nodes are joined across labels by an exact
   set-similarity join (prefix, length and positional filters), so that no link is lost where the centre
   of a star is not similar. Pairs of one label are not tested again: they cannot change components.
5. All links make components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.shipping import map_arrow

from . import words as W
from .components import components, contracted
from .sketch import MinHash, fingerprint
from .store import checkpointed, maybe_in, membership


#: Slots of the shingle counts that order prefixes: 4 MB sent to every task.
SLOTS = 1 << 20


class Likeness(NamedTuple):
    """shingle: words in a shingle; part, whole: texts are linked if whole * |intersection| >= part *
    |union|; bands, rows: of the MinHash; alnum: words are runs of letters and digits (else of
    anything but white space); least_words: texts of fewer words match only by equal sets."""

    shingle: int = 5
    part: int = 80
    whole: int = 100
    bands: int = 20
    rows: int = 4
    alnum: bool = False
    least_words: int = 0

    def words(self, column: pa.Array) -> W.Words:
        return W.tokenize(column, W.ALNUM if self.alnum else W.SPACED)


def _lists(flat: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32()), pa.array(flat, kind))


def _sketch(batch: pa.RecordBatch, how: Likeness, hasher: MinHash) -> tuple:
    """Per row: number of words, of shingles, fingerprints (0 without words); and for rows that take
    part in banding: their numbers, keys and minima."""
    words = how.words(batch.column("text"))
    n_words = words.counts()
    row, value = W.shingles(words, how.shingle)
    n = np.bincount(row, minlength=batch.num_rows)
    one, two = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64)
    one[n > 0], two[n > 0] = fingerprint(row, value)
    near = n_words[row] >= how.least_words
    rows, minima = hasher.minima(row[near], value[near])
    return n_words, n, one, two, rows, hasher.keys(minima), minima


def sketched(texts: DataFrame, how: Likeness) -> DataFrame:
    """texts (id, text) -> id, n_words, n_shingles, one, two (fingerprint; null without words), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(how.bands, how.rows)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                n_words, n, one, two, rows, keys, _ = _sketch(batch, how, hasher)
                per_row = np.zeros(batch.num_rows, dtype=np.int64)
                per_row[rows] = how.bands
                none = n == 0
                arrays = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), _lists(keys.reshape(-1).view(np.int64), per_row, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_shingles", "one", "two", "keys"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts.select("id", "text"), run, f"id {kind}, n_words long, n_shingles long, one long, two long, keys array<long>")


def _candidates(texts: DataFrame, keys: DataFrame, how: Likeness) -> DataFrame:
    """Nodes with a key that may be among keys: node, n, keys (those), minima (a byte each), text."""
    wanted = membership(keys, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = MinHash(how.bands, how.rows), wanted.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                _, n, one, _, rows, found, minima = _sketch(batch, how, hasher)
                inside = maybe_in(table, found)
                some = inside.any(axis=1)
                if not some.any():
                    continue
                rows, found, inside = rows[some], found[some], inside[some]
                low = (minima[:, some].T & np.uint64(255)).astype(np.uint8)
                arrays = [pa.array(one[rows].view(np.int64)), pa.array(n[rows], pa.int64()), _lists(found[inside].view(np.int64), inside.sum(axis=1), pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()), batch.column("text").take(pa.array(rows))]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "keys", "minima", "text"])

    return map_arrow(texts.select("text"), run, "node long, n long, keys array<long>, minima binary, text string").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, how: Likeness) -> DataFrame:
    """Of the pairs (src, dst) those that are similar: by size and signature, then by full sets."""
    least = MinHash(how.bands, how.rows).least_agreement(how.part / how.whole)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for x in ("minima", "minima2"))
                keep = (a == b).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(keep)) for x in ("src", "dst")], ["src", "dst"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", W.SLICE_BYTES // 2):
                sets = [W.shingles(how.words(batch.column(x)), how.shingle) for x in ("text", "text2")]
                row, value = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=batch.num_rows)
                union = np.bincount(row, minlength=batch.num_rows) - both
                keep = pa.array((both * how.whole >= how.part * union) & (both > 0))
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("src", "dst")], ["src", "dst"])

    brief = nodes.select("node", "n", "minima")
    left, right = (brief.toDF(*names) for names in (("src", "n", "minima"), ("dst", "n2", "minima2")))
    near = pairs.join(left, "src").join(right, "dst").filter(F.least("n", "n2") * how.whole >= F.greatest("n", "n2") * how.part)
    # written, as what comes from it is: the driver plans a query anew after each of its stages, whole
    likely = checkpointed(map_arrow(near.select("src", "dst", "minima", "minima2"), agree, "src long, dst long"))
    long = nodes.select("node", "text")
    left, right = (long.toDF(*names) for names in (("src", "text"), ("dst", "text2")))
    return map_arrow(likely.join(left, "src").join(right, "dst").select("src", "dst", "text", "text2"), same, "src long, dst long")


def _prefixes(nodes: DataFrame, how: Likeness) -> DataFrame:
    """nodes (node, label, text) -> node, label, size, token, place: the rarest shingles of each set,
    as many as could be the first that it shares with a similar set, in the order of how many of these
    sets hold a shingle. Counts are kept in SLOTS slots by hash (bounded); slots that coincide only make
    the order less telling: any order that is the same for all sets is exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                _, value = W.shingles(how.words(batch.column("text")), how.shingle)
                total += np.bincount((value & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "n"])

    got = map_arrow(nodes.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SLOTS, dtype=np.int64)
    frequency[got["slot"].to_numpy()] = got["n"].to_numpy()
    sent = nodes.sparkSession.sparkContext.broadcast(np.minimum(frequency, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                row, value = W.shingles(how.words(batch.column("text")), how.shingle)
                often = sent.value[(value & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((value, often, row))
                row, value = row[order], value[order]
                size = np.bincount(row, minlength=batch.num_rows)
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                # overlap with any similar set is at least part / whole of this set
                keep = place <= size[row] - -(-size[row] * how.part // how.whole)
                at = pa.array(row[keep])
                arrays = [batch.column("node").take(at), batch.column("label").take(at), pa.array(size[row[keep]], pa.int64()), pa.array(value[keep].view(np.int64)), pa.array(place[keep], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "label", "size", "token", "place"])

    return map_arrow(nodes, run, "node long, label long, size long, token long, place long")


def _across(nodes: DataFrame, how: Likeness) -> DataFrame:
    """Pairs (src, dst) of nodes (node, label, text) of different labels that may be similar: an exact
    set-similarity join with prefix, length and positional filters, so that sets which differ in enough
    rare shingles never meet, however many share the rest. Labels meet first: a token whose sets all
    have one label gives nothing."""
    part, whole, total = how.part, how.whole, how.part + how.whole
    found = checkpointed(_prefixes(nodes, how))
    # of the sets of one label that hold a token: the bounds that the filters below need
    bounds = lambda frame, k: frame.groupBy("token", F.col("label").alias(f"label{k}")).agg(F.min("size").alias(f"lo{k}"), F.max("size").alias(f"hi{k}"), F.max(F.col("size") - F.col("place")).alias(f"rest{k}"))
    # the smaller set of a pair shares 2 part / (part + whole) of itself, so its prefix is shorter
    lesser = found.filter(f"(size - place) * {total} >= 2 * {part} * size")
    several = found.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("token")
    held = checkpointed(bounds(found, 2).join(several, "token"))
    need = f"{part} * (lo1 + greatest(lo1, lo2))"
    labels = checkpointed(bounds(lesser, 1).join(held, "token").filter(f"label1 <> label2 and lo1 <= hi2 and hi1 * {whole} >= lo2 * {part} and rest1 * {total} >= {need} and rest2 * {total} >= {need}").select("token", "label1", "label2"))
    left = labels.select("token", F.col("label1").alias("label"), "label2").join(lesser, ["token", "label"]).select("token", "label2", F.col("node").alias("src"), F.col("size").alias("n"), F.col("place").alias("p"))
    right = found.select("token", F.col("label").alias("label2"), F.col("node").alias("dst"), F.col("size").alias("n2"), F.col("place").alias("p2"))
    need = f"{part} * (n + n2)"
    near = left.join(right, ["token", "label2"]).filter(f"(n < n2 or (n = n2 and src < dst)) and n * {whole} >= n2 * {part} and (n - p) * {total} >= {need} and (n2 - p2) * {total} >= {need}")
    return checkpointed(near.select("src", "dst").distinct())


def near_classes(texts: DataFrame, how: Likeness) -> DataFrame:
    """texts (id of any orderable type, text) -> id, n_words, n_shingles, class (the least id that can
    be reached over links, the id itself included; null where the text has no words).

    Rows of one id are rows of one result each, with the class of their own text. Null ids take part
    as texts, but never give a class its id. Equal sets are linked whatever the id. A link is missed
    only if no band of the pair agrees: at the threshold with probability (1 - s^rows)^bands.
    """
    rows = checkpointed(sketched(texts, how))
    exploded = rows.filter("one is not null").select(F.explode("keys").alias("key"), "one")
    shared = checkpointed(exploded.groupBy("key").agg(F.min("one").alias("centre"), F.max("one").alias("other")).filter("centre < other").select("key", "centre"))
    nodes = checkpointed(_candidates(texts, shared, how))
    placed = checkpointed(nodes.select("node", F.explode("keys").alias("key")).join(shared, "key"))
    star = placed.filter("node <> centre").select(F.col("centre").alias("src"), F.col("node").alias("dst")).distinct()
    links = contracted(_verified(star, nodes, how))
    # a label tells which nodes are surely in one component; it need not be the component's least
    found = links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))
    labelled = checkpointed(placed.join(found, "node", "left").select("key", "node", F.coalesce("label", F.col("node")).alias("label")))
    open_keys = checkpointed(labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("key"))
    if open_keys.head(1):
        still = checkpointed(labelled.join(open_keys, "key").select("node", "label").distinct())
        more = _verified(_across(nodes.join(still, "node").select("node", "label", "text"), how), nodes, how)
        links = links.unionByName(more)
    final = components(links).withColumnRenamed("component", "label")
    sets = rows.filter("one is not null").groupBy("one", "two").agg(F.min("id").alias("least"))
    sets = checkpointed(sets.join(final, sets["one"] == final["node"], "left").select("one", "two", "least", "label"))
    top = sets.filter("label is not null").groupBy("label").agg(F.min("least").alias("class"))
    # sets without a link stay where they are
    named = sets.join(top, "label").select("one", "two", "class").unionByName(sets.filter("label is null").select("one", "two", F.col("least").alias("class")))
    kept = rows.select("id", "n_words", "n_shingles", "one", "two")
    return kept.join(named, ["one", "two"], "left").select("id", "n_words", "n_shingles", "class")
