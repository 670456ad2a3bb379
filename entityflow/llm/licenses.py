"""License scans: exact phrases, and an exact set-similarity join with license templates (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.shipping import map_arrow

from . import words as W

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-sa", "licensed under a creative commons attribution share alike license"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form without the prior written permission of the publisher"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.85


class Scanner(NamedTuple):
    """vocab: sorted word hashes of phrases and templates, spelled: their bytes; order: the vocabulary's
    rank, rarest in the corpus first; templates: per template label, ranks ascending, required overlap;
    index: per reach (words that lines are joined up to) and rank the (template, position) whose prefix
    holds it; phrases: ids and label."""

    vocab: np.ndarray
    spelled: list[bytes]
    order: np.ndarray
    templates: list[tuple[str, np.ndarray, int]]
    index: dict[int, dict[int, list[tuple[int, int]]]]
    phrases: list[tuple[np.ndarray, str]]


def _tokens(text: str) -> list[bytes]:
    words = W.tokenize(pa.array([text]), W.ALNUM)
    return W.lower_bytes(words, np.arange(len(words.hash)))


def vocabulary(phrases: tuple, templates: tuple) -> tuple[np.ndarray, list[bytes]]:
    spelled = sorted({w for text, _ in phrases for w in _tokens(text)} | {w for _, text in templates for w in _tokens(text)})
    hashes = np.array([W.word_hash(x.decode()) for x in spelled], dtype=np.uint64)
    by = np.argsort(hashes)
    return hashes[by], [spelled[i] for i in by.tolist()]


def reach(template: str) -> int:
    """Lines are joined to a block until they have so many words: twice those of the template."""
    return 2 * len(_tokens(template))


def make_scanner(phrases: tuple, templates: tuple, counts: dict[int, int], containment: float) -> Scanner:
    """counts: in how many lines of the corpus each word of the vocabulary stands."""
    vocab, spelled = vocabulary(phrases, templates)
    place = {w: i for i, w in enumerate(spelled)}
    order = np.empty(len(vocab), dtype=np.int64)
    order[sorted(range(len(vocab)), key=lambda i: (counts.get(i, 0), spelled[i]))] = np.arange(len(vocab))
    made, index = [], {}
    for label, text in templates:
        ranks = np.unique([order[place[w]] for w in _tokens(text)])
        least = math.ceil(len(ranks) * containment - 1e-9)
        for position in range(len(ranks) - least + 1):  # prefix filter: the template's side
            index.setdefault(reach(text), {}).setdefault(int(ranks[position]), []).append((len(made), position))
        made.append((label, ranks, least))
    return Scanner(vocab, spelled, order, made, index, [(np.array([place[w] for w in _tokens(text)]), label) for text, label in phrases])


def _known(words: W.Words, vocab: np.ndarray, spelled: list[bytes]) -> np.ndarray:
    """Place in the vocabulary of each word, or -1; equal hashes are confirmed by length and bytes."""
    at = np.minimum(np.searchsorted(vocab, words.hash), len(vocab) - 1)
    hit = np.flatnonzero(vocab[at] == words.hash)
    out = np.full(len(words.hash), -1)
    same = [a == spelled[i] for a, i in zip(W.lower_bytes(words, hit), at[hit].tolist(), strict=True)]
    hit = hit[np.array(same, dtype=bool)]
    out[hit] = at[hit]
    return out


def _lines(words: W.Words) -> np.ndarray:
    """The first word of each line that has words, and at the end the number of words."""
    line = np.searchsorted(np.flatnonzero(words.data == 10), words.start) + words.row
    new = np.ones(len(line) + 1, dtype=bool)
    new[1:-1] = line[1:] != line[:-1]
    return np.flatnonzero(new)


def template_matches(words: W.Words, known: np.ndarray, scanner: Scanner) -> list[tuple[int, int, int, float]]:
    """(row, first word of the block, template, containment) of each block that reaches the threshold."""
    first, hit, out = _lines(words), np.flatnonzero(known >= 0), []
    if len(first) < 2 or not len(hit):
        return out
    start, rank, n = first[:-1], scanner.order[known[hit]], len(scanner.order)
    row = words.row[start]
    last = np.searchsorted(row, row, side="right")
    low = np.searchsorted(hit, start)
    for reach, index in scanner.index.items():
        end = np.minimum(np.searchsorted(start, start + reach), last)
        size = np.searchsorted(hit, first[end]) - low
        some = np.flatnonzero(size >= min(scanner.templates[t][2] for x in index.values() for t, _ in x))
        size = size[some]
        at = np.arange(size.sum()) + np.repeat(low[some] - (np.cumsum(size) - size), size)
        pairs = np.unique(np.repeat(some, size) * n + rank[at])
        out += [(int(row[b]), int(start[b]), t, share) for b, t, share in _similar(pairs // n, pairs % n, index, scanner)]
    return out


def _similar(block: np.ndarray, rank: np.ndarray, index: dict[int, list[tuple[int, int]]], scanner: Scanner) -> list[tuple[int, int, float]]:
    """(block, template, containment); block and rank are distinct pairs in ascending order."""
    start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(block)))
    number = np.repeat(np.arange(len(start)), size)
    position = np.arange(len(block)) - start[number]
    out, seen = [], set()
    for at in np.flatnonzero(np.isin(rank, np.fromiter(index, dtype=np.int64))).tolist():
        b = int(number[at])
        for t, q in index[int(rank[at])]:
            _, ranks, least = scanner.templates[t]
            here, own = int(position[at]), int(size[b])
            if (b, t) in seen or own < least or here > own - least:  # length filter; prefix filter: the block's side
                continue
            if 1 + min(own - here - 1, len(ranks) - q - 1) < least:  # positional filter
                continue
            seen.add((b, t))
            shared = len(np.intersect1d(rank[start[b] : start[b] + own], ranks, assume_unique=True))
            if shared >= least:
                out.append((int(block[at]), t, shared / len(ranks)))
    return out


def phrase_places(words: W.Words, known: np.ndarray, scanner: Scanner) -> list[tuple[np.ndarray, str]]:
    """For each phrase, the words (numbers over the whole column) where it starts inside one row."""
    out = []
    for ids, label in scanner.phrases:
        last = len(known) - len(ids) + 1
        at = np.flatnonzero(known[: max(last, 0)] == ids[0])
        for k in range(1, len(ids)):
            at = at[(known[at + k] == ids[k]) & (words.row[at + k] == words.row[at])]
        out.append((at, label))
    return out


def line_counts(docs: DataFrame, text: str, phrases: tuple, templates: tuple) -> dict[int, int]:
    """In how many lines of all rows each word of the vocabulary stands: one small row per word and
    task, then one per word."""
    vocab, spelled = vocabulary(phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), dtype=np.int64)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                words = W.tokenize(batch.column("text"), W.ALNUM)
                known = _known(words, vocab, spelled)
                hit = np.flatnonzero(known >= 0)
                line = np.searchsorted(_lines(words), hit, side="right")
                total += np.bincount(np.unique(line * len(vocab) + known[hit]) % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab)), pa.int32()), pa.array(total)], ["word", "n"])

    counted = map_arrow(docs.select(F.col(text).cast("string").alias("text")), run, "word int, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (start words and label of each phrase place, in
    order), blocks (first word, label, containment of each block that holds at least `containment` of a
    template's distinct words), score: the highest containment of a block, at least 0.5 if a phrase
    stands anywhere, else 0.

    A block is a line and, as notices are often wrapped, the lines after it until it has twice the words of
    the template (lines without words do not count). Every line with words begins a block for each template.
    The join is exact: words in ascending order of the number of lines they stand in, prefix, length
    and positional filters, then the whole overlap. Templates and phrases are a fixed list (their size
    is the bound of what tasks get). Null and empty texts have no words; repeated rows are judged alike;
    no rows give no rows; other columns are not read.
    """
    scanner = make_scanner(phrases, templates, line_counts(docs, text, phrases, templates), containment)
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    block_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                words = W.tokenize(batch.column("text"), W.ALNUM)
                known = _known(words, scanner.vocab, scanner.spelled)
                first, n = words.firsts(), batch.num_rows
                base: list[list] = [[] for _ in range(n)]
                blocks: list[list] = [[] for _ in range(n)]
                for places, label in phrase_places(words, known, scanner):
                    for p, r in zip(places.tolist(), words.row[places].tolist(), strict=True):
                        base[r].append({"start": p - int(first[r]), "label": label})
                for r, p, t, share in template_matches(words, known, scanner):
                    blocks[r].append({"start": p - int(first[r]), "label": scanner.templates[t][0], "containment": share})
                score = [max([0.5 if a else 0.0, *(x["containment"] for x in b)]) for a, b in zip(base, blocks, strict=True)]
                order = [sorted(x, key=lambda y: (y["start"], y["label"])) for x in base]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(order, base_type), pa.array(blocks, block_type), pa.array(score, pa.float64())], ["doc_id", "n_words", "base", "blocks", "score"])

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return map_arrow(read, run, f"doc_id {kind}, n_words long, base array<struct<start:long,label:string>>, blocks array<struct<start:long,label:string,containment:double>>, score double")
