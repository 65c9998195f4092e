"""Licence scan: a positional index of the rare words of licence notices, looked up by the words of each file.

How many documents hold each word of the notices is counted over the whole table, and every notice is indexed by its words of
highest IDF only, with their positions. A file looks up the indexed words it holds, which are its rarest licence words; hits of one
notice whose relative positions agree (up to a few inserted or missing words) line up into a candidate, weighed by IDF. A candidate
counts if it has enough of the notice's weight and if the notice's key phrases stand, word by word, where it lies. Names of
licences are searched besides as plain phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import words as W

# Names of licences and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Published notices (label, notice, key phrases that must stand in it).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["free of charge", "without restriction"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("artistic", "this library is free software you can redistribute it and or modify it under the terms of the artistic license", ["artistic license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
]

#: Distinct words by which a notice is indexed, the rarest first.
RARE_WORDS = 8
#: Words by which hits of a notice may be out of place, and the share of its indexed weight that a candidate needs.
DRIFT = 4
LEAST_SHARE = 0.6
#: What a bare name of a licence counts.
NAME_SCORE = 0.5

_SLICE_BYTES = 4 << 20
_CHUNK_WORDS = 1 << 17
#: Lower-cased letters and digits and all bytes beyond ASCII make words, the rest separates them.
_FOLD = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Words:
    """The words of some texts in order: their text's row, and their number in a vocabulary (-1 if they are not in it)."""

    row: np.ndarray
    code: np.ndarray


class Vocabulary:
    """Exact look-up of words that are at most as long as the longest one held: words are compared byte by byte."""

    def __init__(self, held: list[str]):
        self.words = sorted(set(held))
        raw = [w.encode() for w in self.words]
        self.width = max([8, *(-(-len(r) // 8) * 8 for r in raw)])
        packed = np.frombuffer(b"".join(r.ljust(self.width, b"\0") for r in raw), np.uint64).reshape(len(raw), -1)
        key = self._key(packed)
        self.order = np.argsort(key)
        self.key, self.packed = key[self.order], packed[self.order]
        self.number = {w: i for i, w in enumerate(self.words)}

    @staticmethod
    def _key(packed: np.ndarray) -> np.ndarray:
        key = np.zeros(len(packed), np.uint64)
        for column in packed.T:
            key = W.mix(key * np.uint64(31) + column)
        return key

    def codes(self, text: np.ndarray, starts: np.ndarray) -> Words:
        """The words of the texts that ``starts`` cuts ``text`` into. Beyond a mask over the bytes only 6 bytes a word are kept."""
        data = _FOLD[text]
        inside = data != 32
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        heads = starts[:-1][starts[:-1] < len(data)]
        edge[heads] = inside[heads]
        first = np.flatnonzero(edge)
        row = (np.searchsorted(starts, first, "right") - 1).astype(np.int32)
        code = np.full(len(first), -1, np.int16)
        padded = np.concatenate([data, np.full(self.width + 1, 32, np.uint8)])
        for lo in range(0, len(first), _CHUNK_WORDS):
            at = first[lo : lo + _CHUNK_WORDS]
            room = starts[row[lo : lo + _CHUNK_WORDS] + 1] - at
            window = padded[at[:, None] + np.arange(self.width + 1)]
            window[np.arange(self.width + 1) >= room[:, None]] = 32
            open_ = np.logical_and.accumulate(window != 32, axis=1)
            fits = np.flatnonzero(~open_[:, -1])
            packed = np.where(open_[fits, :-1], window[fits, :-1], 0).astype(np.uint8)
            packed = np.ascontiguousarray(packed).view(np.uint64)
            place = np.searchsorted(self.key, self._key(packed))
            place[place == len(self.key)] = 0
            same = (self.packed[place] == packed).all(axis=1)
            code[lo + fits[same]] = self.order[place[same]]
        return Words(row, code)


def _phrase_places(found: Words, phrase: list[int]) -> np.ndarray:
    """Where all words of the phrase stand in a row inside one text."""
    n = len(found.code) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    here = (found.code[:n] == phrase[0]) & (found.row[:n] == found.row[len(phrase) - 1 :])
    for k, word in enumerate(phrase[1:], 1):
        here &= found.code[k : n + k] == word
    return np.flatnonzero(here)


def _frequencies(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary.words), np.int64), 0
        for batch in batches:
            data, starts = W.buffers(batch.column(0))
            n += batch.num_rows
            for lo, hi in W.slices(starts, _SLICE_BYTES):
                found = vocabulary.codes(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
                known = found.code >= 0
                once = np.unique(found.row[known].astype(np.int64) * len(total) + found.code[known])
                total += np.bincount(once % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[n], total]))], names=["word", "n"])

    return run


@dataclass
class Index:
    """Postings of the notices' rarest words: for each word number, (notice, position, IDF) in one array cut by ``cuts``."""

    labels: list[str]
    lengths: np.ndarray
    keys: list[list[list[int]]]
    weights: np.ndarray
    cuts: np.ndarray
    notice: np.ndarray
    place: np.ndarray
    idf: np.ndarray


def build_index(notices: list[tuple[str, str, list[str]]], vocabulary: Vocabulary, documents: int, frequency: np.ndarray) -> Index:
    """The positional index; every notice is in it with its rarest distinct words (ties: the earlier place)."""
    idf = np.array([math.log((documents + 1) / (n + 1)) + 1e-6 for n in frequency.tolist()])
    postings: list[list[tuple[int, int]]] = [[] for _ in vocabulary.words]
    weights, lengths = np.zeros(len(notices)), np.zeros(len(notices), np.int64)
    for t, (_, notice, _) in enumerate(notices):
        spelled = [vocabulary.number[w] for w in notice.split()]
        lengths[t] = len(spelled)
        rare = sorted(dict.fromkeys(spelled), key=lambda w: -idf[w])[:RARE_WORDS]
        for place, word in enumerate(spelled):
            if word in rare:
                postings[word].append((t, place))
                weights[t] += idf[word]
    flat = [(t, p, idf[w]) for w, held in enumerate(postings) for t, p in held]
    return Index(
        [label for label, _, _ in notices], lengths, [[[vocabulary.number[w] for w in k.split()] for k in keys] for _, _, keys in notices], weights,
        np.concatenate([[0], np.cumsum([len(p) for p in postings])]), np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64), np.array([x[2] for x in flat]),
    )


def candidates(index: Index, found: Words) -> Iterator[tuple[int, int, int, float]]:
    """(row, notice, first word, share) of every alignment that has enough of a notice's weight.

    Hits fall into windows of relative position that overlap by half, so hits up to ``DRIFT`` words apart share one; a place of the
    notice counts once in a window. First words are counted from the beginning of the batch.
    """
    at = np.flatnonzero(found.code >= 0)
    word = found.code[at].astype(np.int64)
    many = index.cuts[word + 1] - index.cuts[word]
    at, word, many = at[many > 0], word[many > 0], many[many > 0]
    if not len(at):
        return
    hit = np.repeat(index.cuts[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(at, many)
    row, notice, place = found.row[at].astype(np.int64), index.notice[hit], index.place[hit]
    offset = at - place + int(index.lengths.max())
    # Two windows for every hit; equal (row, notice, window, place) count once.
    window = np.concatenate([2 * (offset // (2 * DRIFT)), 2 * ((offset + DRIFT) // (2 * DRIFT)) + 1])
    row, notice, place, start, weight = (np.concatenate([x, x]) for x in (row, notice, place, at - place, index.idf[hit]))
    order = np.lexsort((start, place, window, notice, row))
    row, notice, place, window, start, weight = (x[order] for x in (row, notice, place, window, start, weight))
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (notice[1:] != notice[:-1]) | (window[1:] != window[:-1])])
    weight = np.where(new | np.concatenate([[True], place[1:] != place[:-1]]), weight, 0.0)
    group = np.flatnonzero(new)
    share = np.add.reduceat(weight, group) / index.weights[notice[group]]
    lowest = np.minimum.reduceat(start, group)
    for g in np.flatnonzero(share >= LEAST_SHARE):
        yield int(row[group[g]]), int(notice[group[g]]), int(lowest[g]), min(1.0, round(float(share[g]), 9))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index, phrases = shared.value
        for batch in batches:
            data, starts = W.buffers(batch.column(1))
            sizes = np.zeros(batch.num_rows, np.int64)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, hi in W.slices(starts, _SLICE_BYTES):
                found = vocabulary.codes(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
                count = np.bincount(found.row, minlength=hi - lo)
                sizes[lo:hi] = count
                origin = np.cumsum(count) - count
                for label, phrase in phrases:
                    for x in _phrase_places(found, phrase).tolist():
                        r = int(found.row[x])
                        spans[lo + r].append({"label": label, "kind": "name", "start": x - int(origin[r]), "words": len(phrase), "share": NAME_SCORE})
                # Windows overlap, so a notice may show up twice at a place; the better one stays.
                best: dict[tuple[int, int, int], dict] = {}
                places: dict[int, list[np.ndarray]] = {}
                for r, t, first, share in candidates(index, found):
                    if t not in places:
                        places[t] = [_phrase_places(found, k) for k in index.keys[t]]
                    last = min(first + int(index.lengths[t]) + 2 * DRIFT, int(origin[r] + count[r]))
                    first = max(first - DRIFT, int(origin[r]))
                    inside = [x[np.searchsorted(x, first)] if np.searchsorted(x, first) < np.searchsorted(x, last - len(k), "right") else None for x, k in zip(places[t], index.keys[t])]
                    if None not in inside:
                        span = {"label": index.labels[t], "kind": "notice", "start": first - int(origin[r]), "words": last - first, "share": share}
                        place = (lo + r, t, first // (2 * DRIFT))
                        if place not in best or best[place]["share"] < share:
                            best[place] = span
                for (r, _, _), span in best.items():
                    spans[r].append(span)
            out = [sorted(s, key=lambda x: (x["start"], x["words"], x["label"], x["kind"], x["share"])) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(out, _SPANS)], names=["id", "n_words", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))


def scan(df: DataFrame, notices: list[tuple[str, str, list[str]]] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, and ``spans``, the licence names and notices in it, by their first word.

    A span has its ``label``, its ``kind`` (``name`` or ``notice``), ``start`` and ``words`` (a notice's span is where it was verified,
    with room for words put in), and ``share``: of the notice's indexed weight, or ``NAME_SCORE`` for a name. A null or empty text has
    no words and no spans. Rows are judged where they lie, so repeated rows and null ids stand for themselves; only the two named
    columns are read, and an empty table gives an empty result. Texts are scanned whole; a text beyond a few MB is a slice of its own.

    Document frequencies come from a first pass over the whole table: one number for each word of the notices. What is broadcast is
    the notices' index, whose size does not depend on the table.
    """
    spark = df.sparkSession
    notices = NOTICES if notices is None else notices
    phrases = PHRASES if phrases is None else phrases
    vocabulary = Vocabulary([w for label, text, keys in notices for w in " ".join([text, *keys]).split()] + " ".join(phrases).split())
    counted = df.select(F.col(text_col).alias("t")).mapInArrow(_frequencies(vocabulary), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # One row for each word of the notices, however large the table.
    frequency = np.zeros(len(vocabulary.words) + 1, np.int64)
    for r in counted.collect():
        frequency[r["word"] + 1] = r["n"]
    index = build_index(notices, vocabulary, int(frequency[0]), frequency[1:])
    shared = spark.sparkContext.broadcast((vocabulary, index, [(label, [vocabulary.number[w] for w in p.split()]) for p, label in phrases.items()]))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    spans = "array<struct<label:string,kind:string,start:bigint,words:bigint,share:double>>"
    return rows.mapInArrow(_scan(shared), f"id bigint, n_words bigint, spans {spans}").withColumnRenamed("id", id_col)


def labelled(scanned: DataFrame) -> list[Column]:
    """The digest of ``scan``: number of names, first and last place, labels of names and of everything, and the best share."""
    names = F.filter("spans", lambda s: s["kind"] == "name")
    starts = F.transform(names, lambda s: s["start"])

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return [
        F.size(names).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names).alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    ]
