"""Vector arithmetic on array columns, and batched scoring of many rows against a few query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.columns import col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def usable(vector: str | Column, dim: int) -> Column:
    """Right dimension and not all zeros."""
    v = col(vector)
    return F.coalesce((F.size(v) == dim) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine_with(vector: str | Column, query: list[float]) -> Column:
    """Cosine of every row with one query vector, computed per Arrow batch; the row keeps its other columns."""
    q = np.asarray(query, dtype=np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-300)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        rows = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(rows @ q / np.maximum(np.linalg.norm(rows, axis=1), 1e-300))

    return score(col(vector))


def top_matches(df: DataFrame, id_column: str, vector: str, queries: dict[int, list[float]], k: int | None) -> DataFrame:
    """Cosine of every row with every query vector as (query_id, id, score).

    One matrix product per Arrow batch. With ``k``, a batch hands on only its best k rows per query (ties by id), which is
    exact for a later overall top-k and keeps the output small however large the corpus is. The query set is a parameter of
    the call, so it is small by construction. The scoring function refers to nothing of this package, so executors need only
    numpy and Arrow.
    """
    query_ids = list(queries)
    dim = len(next(iter(queries.values())))
    q = np.asarray([queries[i] for i in query_ids], dtype=np.float64)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    schema = pa.schema([("query_id", pa.int64()), (id_column, pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column(0), dtype=np.int64)
            rows = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
            scores = (rows @ q.T) / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            for j, query_id in enumerate(query_ids):
                s = scores[:, j]
                best = np.lexsort((ids, -s))[:k] if k is not None else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[best]), query_id)), pa.array(ids[best]), pa.array(s[best])], schema=schema)

    pairs = df.filter(usable(vector, dim)).select(F.col(id_column).cast("bigint"), F.col(vector))
    return pairs.mapInArrow(score, f"query_id bigint, {id_column} bigint, score double")
