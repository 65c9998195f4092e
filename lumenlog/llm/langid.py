"""Language identification: multinomial naive Bayes over hashed character n-grams.

A table of log probabilities, languages by buckets, is learned from labelled rows and broadcast; its size is fixed by the number of
buckets and languages. Texts are scored in batches as sums of table rows, without building a feature vector.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import words as W
from lumenlog.session import local_table

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
#: Labelled rows to learn from, for each language (about as many, picked by a hash of the id; all if there are fewer).
ROWS_PER_LANGUAGE = 2000
#: Languages a model may have; with the buckets it bounds what is broadcast.
MOST_LANGUAGES = 256
UNKNOWN = "und"
#: Bytes of text scored at a time (fewer for many languages), or counted (up to four times as many for many languages); a byte takes
#: some 70 on the way.
SLICE_BYTES = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def features(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, text starts, which texts have a letter) of the texts in ``data``, once for each n-gram length.

    An n-gram that would reach into the next text gets bucket ``BUCKETS``, which weighs nothing.
    """
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = _letters()[points].astype(np.uint64)
    n = len(points)
    letters = np.concatenate([[0], np.cumsum(points != 32)])
    some = letters[heads[1:]] > letters[heads[:-1]]
    joined = np.zeros(n, np.uint64)
    ends = heads[1:][heads[1:] > heads[:-1]]
    for size in range(1, max(GRAMS) + 1):
        if n >= size:
            joined[: n - size + 1] = joined[: n - size + 1] * np.uint64(0x9E3779B97F4A7C15) + points[size - 1 :] + np.uint64(1)
        if size in GRAMS:
            hashed = joined * np.uint64(0xD6E8FEB86659FD93)
            bucket = ((hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)
            for back in range(1, size):
                over = ends - back
                bucket[over[over >= 0]] = BUCKETS
            yield bucket, heads, some


@dataclass
class Model:
    """Languages in order of their names, and the weights of every bucket for each; the last row of weights is the prior."""

    languages: list[str]
    weights: np.ndarray


def _counts(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + 1), np.int64)
        for batch in batches:
            lang = np.asarray([number[x] for x in batch.column(1).to_pylist()], np.int64)
            data, starts = W.buffers(batch.column(0))
            for lo, hi in W.slices(starts, min(4 * SLICE_BYTES, max(SLICE_BYTES, len(languages) << 16))):
                for bucket, heads, _ in features(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]):
                    owner = np.repeat(lang[lo:hi], np.diff(heads))
                    total += np.bincount(owner * (BUCKETS + 1) + bucket, minlength=total.size).reshape(total.shape)
        total[:, BUCKETS] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    return run


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows with a text and a language. Without such rows the model knows no language."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).filter("t IS NOT NULL AND lang IS NOT NULL")
    found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [x for x, _ in found]
    if not found:
        return Model([], np.zeros((BUCKETS + 2, 0), np.float32))
    share = local_table(spark, [(x, min(1.0, rows_per_language / n)) for x, n in found], "lang string, share double")
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").filter(place < F.col("share")).select("t", "lang")
    total = np.zeros((len(languages), BUCKETS + 1))
    # At most languages * buckets rows.
    for r in sample.mapInArrow(_counts(languages), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        total.ravel()[r["at"]] = r["n"]
    counts = total[:, :BUCKETS] + SMOOTHING
    weights = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    weights -= weights.mean(0, keepdims=True)
    prior = np.log(np.asarray([n for _, n in found], float) / sum(n for _, n in found))
    table = np.concatenate([weights.T, np.zeros((1, len(languages))), prior[None]]).astype(np.float32)
    return Model(languages, table)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known = len(model.languages)
        for batch in batches:
            data, starts = W.buffers(batch.column(1))
            best, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for lo, hi in W.slices(starts, min(SLICE_BYTES, max(1 << 16, (4 << 20) // max(1, known)))):
                total = np.tile(model.weights[-1].astype(np.float64), (hi - lo, 1))
                for bucket, heads, some in features(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]):
                    full = np.flatnonzero(heads[1:] > heads[:-1])
                    if len(full) and known:
                        for k in range(known):
                            total[full, k] += np.add.reduceat(model.weights[:, k][bucket], heads[full], dtype=np.float64)
                if not known:
                    continue
                pick = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(some):
                    best[lo + i], sure[lo + i] = model.languages[pick[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(sure)], names=["id", "lang_pred", "score"])

    return run


def detect(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred`` and its probability ``score``.

    A text that is null or has no letter, and every text for a model without languages, is ``und`` with score 0. Of equally likely
    languages the first by name is taken. Repeated rows are scored each for itself. Only the two named columns are read; an empty
    table gives an empty result. Texts are scored whole, in slices of bounded size (a longer text alone).
    """
    shared = df.sparkSession.sparkContext.broadcast(Model(model.languages, np.asfortranarray(model.weights)))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_score(shared), "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _keep(shared, text: int, lang: int):
    score = _score(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nothing = pa.nulls(batch.num_rows)
            pair = pa.RecordBatch.from_arrays([nothing, batch.column(text)], names=["id", "t"])
            found = next(score(iter([pair]))).column(1)
            columns = [found.cast(c.type) if i == lang else c for i, c in enumerate(batch.columns)]
            whole = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield whole.filter(pc.not_equal(found, UNKNOWN))

    return run


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language can be told, with it in place of the given one; texts that are null or without a letter go.

    The model learns from the labelled rows that ``remainder`` modulo 5 does not hold out; where there are none, languages stay as
    they are. Rows are judged where they lie, so nothing is shuffled and ids need not be unique: repeated rows are judged alike and
    all stay or go. Of equally likely languages the first by name is taken. Other columns are carried along, whatever their names.
    An empty table gives an empty result.
    """
    model = train(df.filter(remainder(id_col, 5) != 0), id_col, text_col, lang_col)
    if not model.languages:
        return df.filter(F.col(text_col).rlike(r"\p{L}"))
    shared = df.sparkSession.sparkContext.broadcast(Model(model.languages, np.asfortranarray(model.weights)))
    return df.mapInArrow(_keep(shared, df.columns.index(text_col), df.columns.index(lang_col)), df.schema)
