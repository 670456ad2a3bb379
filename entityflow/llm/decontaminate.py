"""Benchmark decontamination with suffix arrays of the training text (operator 2).

The training text is taken in shards (pieces of Arrow batches). The words of a shard that the test set
has too become numbers; every maximal stretch of such words that is long enough to hold a window goes,
whole, into the shard's suffix array, which is sorted by prefix doubling as deep as the longest test
item. Every test suffix is then binary-searched in it: its neighbours give the longest verbatim match
and its place, and the range of suffixes that begin with a whole window gives all places of the window.
Stretches shorter than the shortest window cannot hold a match and are left out, which changes no
result. The test set is a stated query set: it is taken in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from entityflow.shipping import map_arrow

from . import words as W
from .store import row_key, small_side

#: Most bytes of test text in a block, the bound of what is sent to every task.
BLOCK_BYTES = 8 << 20


class Index(NamedTuple):
    """A block of test items. vocab: sorted hashes of its words; spelled: their bytes; ids: the items'
    words as 1 + place in vocab, 0 after each item; item, left, window: of each word its distinct text's
    number, the words to its end and the window's length; names: item ids of each distinct text."""

    vocab: np.ndarray
    spelled: list[bytes]
    ids: np.ndarray
    item: np.ndarray
    left: np.ndarray
    window: np.ndarray
    names: list[list]


def index_items(names: list, texts: list, window: int) -> Index:
    words = W.tokenize(pa.array(texts, pa.string()), W.ALNUM)
    vocab, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    spelled = W.lower_bytes(words, at)
    first = words.firsts()
    classes: dict[bytes, int] = {}
    members: list[list] = []
    ids, item, left, length = [], [], [], []
    for i, name in enumerate(names):
        own = inverse[first[i] : first[i + 1]] + 1
        if not len(own):
            continue
        k = classes.setdefault(own.tobytes(), len(members))
        if k < len(members):
            members[k].append(name)
            continue
        members.append([name])
        ids.append(np.append(own, 0))
        item.append(np.full(len(own) + 1, k))
        left.append(np.arange(len(own), -1, -1))
        length.append(np.full(len(own) + 1, min(window, len(own))))
    joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (ids, item, left, length)]
    return Index(vocab, spelled, *joined, members)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of nonzero words in the order of the suffixes there, each up to the next 0, as deep as
    `depth` words at least."""
    n = len(ids)
    rank, h = ids.copy(), 1
    places = np.flatnonzero(ids)
    if not len(places):
        return places
    order = places[np.argsort(rank[places], kind="stable")]
    run = np.zeros(n + 1, dtype=np.int64)  # words to the next 0
    zeros = np.flatnonzero(np.append(ids, 0) == 0)
    run[:n] = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)
    while h < depth:
        longer = run[places] > h
        second = np.zeros(n, dtype=np.int64)
        second[places[longer]] = rank[places[longer] + h]
        key = rank[places] * (n + len(ids) + int(rank.max()) + 2) + second[places]
        by = np.argsort(key, kind="stable")
        order, sorted_key = places[by], key[by]
        new = np.ones(len(order), dtype=np.int64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new)
        h *= 2
        if new.all():
            break
    return order


def _shared(ids: np.ndarray, places: np.ndarray, tests: np.ndarray, test: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal words from each training place and test place on, `most` at most."""
    got = np.zeros(len(places), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        a, b = ids[places[live] + got[live]], tests[test[live] + got[live]]
        live = live[(a == b) & (a != 0)]
        got[live] += 1
        live = live[got[live] < most[live]]
    return got


def _search(ids: np.ndarray, order: np.ndarray, tests: np.ndarray, test: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """For each test place, where its suffix cut to `most` words stands in the array: before all
    suffixes that begin with it, or after them."""
    lo, hi = np.zeros(len(test), dtype=np.int64), np.full(len(test), len(order), dtype=np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        same = _shared(ids, order[mid], tests, test[open_], most[open_])
        whole = same == most[open_]
        less = np.where(whole, after, ids[order[mid] + same] < tests[np.minimum(test[open_] + same, len(tests) - 1)])
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    return lo


def _known(words: W.Words, index: Index, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's words as numbers with 0 between stretches, and for each the word's place; only
    stretches of test words of at least the shortest window, compared by their bytes."""
    at = np.minimum(np.searchsorted(index.vocab, words.hash), len(index.vocab) - 1)
    ids = np.where(index.vocab[at] == words.hash, at + 1, 0)
    row = words.row

    def stretches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        live = ids != 0
        new = live.copy()
        new[1:] &= ~(live[:-1] & (row[1:] == row[:-1]))
        starts = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        sizes = np.bincount(number[live], minlength=len(starts))
        keep = live & (sizes[np.maximum(number, 0)] >= shortest) if len(starts) else live
        return keep, number

    keep, _ = stretches(ids)
    place = np.flatnonzero(keep)
    spelled = W.lower_bytes(words, place)
    wrong = [p for p, s in zip(place.tolist(), spelled, strict=True) if s != index.spelled[ids[p] - 1]]
    if wrong:  # equal hashes of different words
        ids[wrong] = 0
    keep, number = stretches(ids)
    place = np.flatnonzero(keep)
    if not len(place):
        return np.zeros(1, dtype=np.int64), np.full(1, -1)
    shift = np.concatenate(([0], np.cumsum(number[place][1:] != number[place][:-1])))
    out = np.zeros(len(place) + shift[-1] + 1, dtype=np.int64)
    where = np.full(len(out), -1, dtype=np.int64)
    out[np.arange(len(place)) + shift] = ids[place]
    where[np.arange(len(place)) + shift] = place
    return out, where


def shard_matches(column: pa.Array, index: Index, deep: bool = True) -> dict[str, np.ndarray | list]:
    """n_words, hit spans (row, from, to) and items per row, and per row its longest verbatim match:
    words, word it starts at, item (number of the distinct text) and word in the item."""
    words = W.tokenize(column, W.ALNUM)
    rows = len(column)
    out: dict = {"n_words": words.counts(), "hits": [np.zeros(0, dtype=np.int64)] * 2, "found": [[] for _ in range(rows)], "longest": np.zeros((rows, 4), dtype=np.int64)}
    if not len(index.ids) or not len(words.hash):
        return out
    ids, where = _known(words, index, int(index.window[index.ids != 0].min()))
    order = suffix_array(ids, int(index.left.max()))
    if not len(order):
        return out
    first = words.firsts()
    tests = index.ids
    # all places of each distinct window
    test = np.flatnonzero((index.left >= index.window) & (tests != 0))
    width = index.window[test]
    lo = _search(ids, order, tests, test, width, after=False)
    hi = _search(ids, order, tests, test, width, after=True)
    some = hi > lo
    test, width, lo, hi = test[some], width[some], lo[some], hi[some]
    if not len(test):
        return out
    span, inverse = np.unique(np.stack([lo, hi, width]), axis=1, return_inverse=True)
    holders: list[set] = [set() for _ in range(span.shape[1])]
    for s, t in zip(inverse.ravel().tolist(), test.tolist(), strict=True):
        holders[s].add(int(index.item[t]))
    size = span[1] - span[0]
    which = np.repeat(np.arange(span.shape[1]), size)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    place = where[order[span[0][which] + inside]]
    row = words.row[place]
    out["hits"] = [place, place + span[2][which]]
    for r, s in np.unique(np.stack([row, which]), axis=1).T.tolist():
        out["found"][r].append(holders[s])
    if deep:  # longest match: extend every place of a window by each of its test places
        starts: list[list[int]] = [[] for _ in range(span.shape[1])]
        for s, t in zip(inverse.ravel().tolist(), test.tolist(), strict=True):
            if all(not _same_tail(tests, t, u) for u in starts[s]):
                starts[s].append(t)
        for s, own in enumerate(starts):
            at = order[span[0][s] : span[1][s]]
            for t in own:
                n = _shared(ids, at, tests, np.full(len(at), t), np.full(len(at), index.left[t]))
                rr = words.row[where[at]]
                better = np.lexsort((where[at], -n, rr))
                lead = better[np.concatenate(([True], rr[better][1:] != rr[better][:-1]))]
                for r, k, p in zip(rr[lead].tolist(), n[lead].tolist(), where[at][lead].tolist(), strict=True):
                    if k > out["longest"][r, 0]:
                        out["longest"][r] = k, p - first[r], index.item[t], index.left[np.flatnonzero(index.item == index.item[t])[0]] - index.left[t]
    return out


def _same_tail(tests: np.ndarray, a: int, b: int) -> bool:
    """Whether the suffixes of the test set at a and b are equal up to their ends."""
    while tests[a] and tests[a] == tests[b]:
        a, b = a + 1, b + 1
    return tests[a] == tests[b]


_RESULT = "n_words long, hits array<struct<start:long,end:long>>, items array<{item}>, longest struct<words:long,start:long,item:{item},item_start:long>"


def find_matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hits (merged stretches of words inside an occurrence
    of a window), items (ids of the items that have an occurring window, sorted, each once) and longest
    (the longest verbatim match that holds a window: words, word it starts at, item, word of the item).

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.
    Null and empty texts have no words; null item ids take part but are not listed among items. Equal
    items are searched once. Rows that repeat are judged alike; no rows give no rows, no items no hits.
    A test set larger than block_bytes is searched block after block in the same tasks, without a shuffle.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    kind = items.schema["item"].dataType
    wide = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    block = F.pmod(F.xxhash64("text"), F.lit(wide))
    read = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {read.schema['doc_id'].dataType.simpleString()}, " + _RESULT.format(item=kind.simpleString())
    for k in range(wide):
        got = (items.filter(block == k) if wide > 1 else items).collect()
        sent = spark.sparkContext.broadcast(index_items([r["item"] for r in got], [r["text"] for r in got], window))
        read = map_arrow(read, _searcher(sent, kind), schema + ", text string")
    return read.drop("text")


def _searcher(sent, kind: T.DataType):  # noqa: ANN001, ANN202
    """Adds one block's matches to those of the blocks before, row by row."""
    name = to_arrow_type(kind)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    best = pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", name), ("item_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                got = shard_matches(batch.column("text"), index)
                n = batch.num_rows
                start, end = got["hits"]
                base = np.concatenate(([0], np.cumsum(got["n_words"])))
                row = np.searchsorted(base, start, side="right") - 1
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(n + 1))
                old = {c: batch.column(c).to_pylist() for c in ("hits", "items", "longest")} if "hits" in batch.schema.names else {}
                hits, items, longest = [], [], []
                for r in range(n):
                    own = order[cut[r] : cut[r + 1]]
                    spans = list(zip((start[own] - base[r]).tolist(), (end[own] - base[r]).tolist(), strict=True))
                    names = {x for k in set().union(*got["found"][r]) for x in index.names[k] if x is not None}
                    words, at, k, there = got["longest"][r].tolist()
                    most = {"words": words, "start": at, "item": index.names[k][0], "item_start": there} if words else None
                    if old:
                        spans += [(x["start"], x["end"]) for x in old["hits"][r]]
                        names |= set(old["items"][r])
                        most = max((x for x in (old["longest"][r], most) if x), key=lambda x: x["words"], default=None)
                    hits.append(_merged(spans))
                    items.append(sorted(names))
                    longest.append(most)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got["n_words"], pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(name)), pa.array(longest, best), batch.column("text")], ["doc_id", "n_words", "hits", "items", "longest", "text"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:  # noqa: ANN003
    """docs, all columns, without the rows whose text has a hit. Rows are judged by their own text, whatever
    other rows have their id; null and empty texts stay; no rows give no rows."""
    keyed = docs.select(row_key(id, text).alias("_key"), F.col(text).alias("_text"))
    bad = find_matches(keyed, benchmark, "_key", "_text", **how).filter(F.size("hits") > 0).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(small_side(bad), row_key(id, text) == F.col("_bad"), "left_anti")
