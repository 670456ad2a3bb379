"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences. A sentence's score is logistic in its distinct words and beginnings
of words (languages that inflect spell one word in many ways), a document's is the noisy-or of its
sentences' scores, and the weights are trained from document labels alone; the
sentence scores then tell which sentences offend.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.shipping import map_arrow

from . import words as W
from .sample import labelled_sample

#: Most labelled documents, and bytes of their text, that the classifier is fitted on.
MOST_TRAINING = 8000
MOST_TRAINING_BYTES = 32 << 20
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True  # line ends and . ! ?


_PIECE, _SLOTS = 1 << 20, 1 << 22
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)


class Model(NamedTuple):
    """words: sorted hashes of features; weights: of each; bias: of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def sentences(words: W.Words) -> np.ndarray:
    """A number per word that grows from sentence to sentence and row to row."""
    key = np.searchsorted(np.flatnonzero(_ENDS[words.data]), words.start) + words.row
    return np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(key) else key


def families(words: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the word and hash of each feature: the words, then the beginnings of longer ones."""
    yield np.arange(len(words.hash)), words.hash
    for k in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > k)
        h = np.full(len(long), k, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + W.LOWER[words.data[words.start[long] + j]].astype(np.uint64)
        yield long, W.mix(h)


def _found(words: W.Words, wanted: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and place in wanted (sorted hashes) of each wanted feature, once a sentence."""
    if not len(wanted):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    parts = []
    for number, value in families(words):
        at = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == value)
        parts.append((sentence[number[hit]], at[hit]))
    return _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _distinct(sentence: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((word, sentence))
    sentence, word = sentence[order], word[order]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (word[1:] != word[:-1])
    return sentence[new], word[new]


def _sentence_scores(model: Model, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, score and first word of each sentence."""
    sentence = sentences(words)
    if not len(sentence):
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    z = np.full(len(first), model.bias)
    s, w = _found(words, model.words, sentence)
    z += np.bincount(s, model.weights[w], len(first))
    return words.row[first], 1 / (1 + np.exp(-np.clip(z, -30, 30))), first


def noisy_or(row: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """1 minus the product of 1 - score, per row; 0 for a row without sentences."""
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(score, 1 - 1e-12)), n))


def _telling(both: np.ndarray, toxic: np.ndarray, rate: float, error: float = 0.05, many: int = 0) -> np.ndarray:
    """Features whose documents are toxic more or less often than the rate by more than chance allows:
    the Chernoff bound of the binomial tail, with Bonferroni's correction for their number (or `many`)."""
    n, p = np.maximum(both, 1), toxic / np.maximum(both, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log(p / rate), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - rate)), 0)
    return n * gain >= np.log(max(many, len(both), 1) / error)


def _wanted(batch: pa.RecordBatch, y: np.ndarray) -> np.ndarray:
    """Hashes of the telling features, ascending. Documents are counted in slots of a hash first, then
    exactly for the features of telling slots; the text is taken in pieces, for the driver's memory."""

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        d = 0
        for part in W.slices(batch, "text", _PIECE):
            words = W.tokenize(part.column(0), W.ALNUM)
            for number, value in families(words):
                row, kept = _distinct(words.row[number], value)
                yield y[row + d], kept
            d += part.num_rows

    both, bad = np.zeros(_SLOTS, dtype=np.int32), np.zeros(_SLOTS, dtype=np.int32)
    slot = lambda value: (value & np.uint64(_SLOTS - 1)).astype(np.int64)
    for toxic, value in pieces():
        at, inverse = np.unique(slot(value), return_inverse=True)
        both[at] += np.bincount(inverse, minlength=len(at)).astype(np.int32)
        bad[at] += np.bincount(inverse, toxic, len(at)).astype(np.int32)
    used = np.flatnonzero(both)
    telling = np.zeros(_SLOTS, dtype=bool)
    telling[used] = _telling(both[used], bad[used], y.mean())
    counts: dict[int, list[int]] = {}
    for toxic, value in pieces():
        hit = telling[slot(value)]
        for v, t in zip(value[hit].tolist(), toxic[hit].tolist(), strict=True):
            c = counts.setdefault(v, [0, 0])
            c[0] += 1
            c[1] += int(t)
    exact = np.array([(v, *c) for v, c in counts.items()], dtype=np.uint64).reshape(-1, 3)
    keep = _telling(exact[:, 1].astype(np.int64), exact[:, 2].astype(np.int64), y.mean(), many=len(used))
    return np.sort(exact[keep, 0])


def fit(texts: list[str], toxic: list[int], rounds: int = 150) -> Model:
    """Gradient descent (Adam) on the mean log loss of the noisy-or, over the features that are telling
    by themselves (else chance fits what no feature explains). One class alone gives its own rate."""
    empty = np.zeros(0, dtype=np.uint64)
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(empty, np.zeros(0), 12.0 if len(y) and y[0] == 1 else -12.0)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    wanted = _wanted(batch, y)
    found, rows, n, d = [], [], 0, 0
    for part in W.slices(batch, "text", _PIECE):
        words = W.tokenize(part.column(0), W.ALNUM)
        sentence = sentences(words)
        first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if len(sentence) else sentence
        s, w = _found(words, wanted, sentence)
        found.append((s + n, w))
        rows.append(words.row[first] + d)
        n, d = n + len(first), d + part.num_rows
    s, w = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.concatenate(rows)
    weights, bias = np.zeros(len(wanted)), -4.0
    m, q, mb, qb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    rate = 0.1
    for step in range(1, rounds + 1):
        z = bias + np.bincount(s, weights[w], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), d))
        whole = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        # d loss / d z: for a sentence p, against toxic documents scaled by the odds left to the others
        g = np.where(y[row] == 1, -p * (clean[row] / whole[row]), p) / d
        gw, gb = np.bincount(w, g[s], len(weights)), g.sum()
        m, q, mb, qb = 0.9 * m + 0.1 * gw, 0.99 * q + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * qb + 0.01 * gb * gb
        scale = rate / (1 - 0.9**step)
        weights -= scale * m / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
        bias -= scale * mb / (np.sqrt(qb / (1 - 0.99**step)) + 1e-6)
    return Model(wanted, weights, float(bias))


def held_out(id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id is held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_TRAINING, most_bytes: int = MOST_TRAINING_BYTES) -> Model:
    """The model of labelled documents that are not held out: the `most` of the least MD5 of the id, as
    far as most_bytes of text reach. Null labels and texts do not train."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).alias("_y")).filter(~held_out(F.col("_id")))
    got = labelled_sample(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), known, "_text", most, most_bytes)
    return fit([t for t, _ in got], [int(y) for _, y in got])


def score_toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", offending: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, score, sentences (number), offends: struct(start word, score) of
    each sentence with a score of at least `offending`, in order.

    Null and empty texts have no sentences and score 0. Repeated rows are judged alike; no rows give no
    rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    kind = pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                words = W.tokenize(batch.column("text"), W.ALNUM)
                row, score, first = _sentence_scores(model, words)
                n, base = batch.num_rows, words.firsts()
                offends: list[list] = [[] for _ in range(n)]
                for k in np.flatnonzero(score >= offending).tolist():
                    offends[row[k]].append({"start": int(first[k] - base[row[k]]), "score": float(score[k])})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(noisy_or(row, score, n)), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(offends, kind)], ["doc_id", "score", "sentences", "offends"])

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(read, run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, score double, sentences long, offends array<struct<start:long,score:double>>")


def crc_fold(id: object) -> int:
    """The held-out remainder of one id, as held_out() has it."""
    return zlib.crc32(str(id).encode()) % 5
