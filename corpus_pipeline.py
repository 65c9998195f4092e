"""The corpus pipeline: languages, exact copies, similar texts, source mix, packed sequences.

Each stage reads what the one before wrote and works on all of it. Inputs and results are tables of ``documents`` columns; the last
stage returns the packing. All stages read whole texts, however long, take ids that repeat or are null, and give an empty result for
an empty table; all but the last carry other columns along, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm import exact_dedup, langid, mixing, ngram_join, packing
from lumenlog.llm.shipping import ship_code
from lumenlog.session import collected_scratch, materialize, remove_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Bytes of a batch that goes to a Python worker; executors and their workers stay for all stages, and each keeps some batches' memory.
BATCH_BYTES = 2 << 20

#: Scratch folders of the stage before, by application.
_scratch: dict[str, list[str]] = {}


def stage(work: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage that runs ``work``. By contract its documents have been written, so what the stage before it kept on the way is removed
    first; where they still read from such a folder, it stays."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_code(spark, BATCH_BYTES)
        app = spark.sparkContext.applicationId
        left = remove_scratch(spark, _scratch.pop(app, []), docs)
        with collected_scratch() as made:
            out = work(docs)
        _scratch[app] = left + made
        return out

    return run


@stage
def languages(docs: DataFrame) -> DataFrame:
    """Documents get the language their text is in; texts that are null or without a letter go. Repeated rows are judged alike, and
    of equally likely languages the first by name is taken."""
    return langid.keep_identified(docs)


@stage
def exact_copies(docs: DataFrame) -> DataFrame:
    """Of equal texts one row with the smallest id stays, null ids last (of several with that id the one written first); a null text
    equals an empty one."""
    return exact_dedup.drop_exact_copies(docs)


@stage
def similar_texts(docs: DataFrame) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more on five-word shingles, one row with the smallest id stays, null ids
    last (of several with that id the one written first). Texts that are null or without words are linked with none and stay."""
    return ngram_join.drop_similar(docs, n=5, percent=80)


@stage
def source_mix(docs: DataFrame) -> DataFrame:
    """Sources in their target weights; a document that is taken several times has as many rows. A null source is one of its own, and
    texts without words are not taken."""
    return mixing.mixed_documents(docs)


@stage
def sequences(docs: DataFrame) -> DataFrame:
    """The packing of all documents, repeated rows each for itself; a null text is empty."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("ngram_join", similar_texts),
    ("mixing", source_mix),
    ("best_fit_packing", sequences),
]

#: Languages come from a trained model, so SQL cannot give these rows; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, run_stage in STAGES[:-1]:
        docs = materialize(run_stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
