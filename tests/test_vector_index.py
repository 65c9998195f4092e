"""Searches for many queries at once against brute force, and the stored index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import vector_index as v

SCHEMA = "vec_id long, embedding array<float>, id long, part string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, x, 0, "p") for i, x in vectors], SCHEMA)


def some(seed, n, dim=8, copies=0):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)]) for i in range(n)]
    return rows + [(n + i, list(rows[1][1])) for i in range(copies)]


def plain(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([x for _, x in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in asked:
        x = m[list(ids).index(q)]
        out[q] = ids[np.lexsort((ids, -np.round(m @ x, 12)))[:k]].tolist()
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(v, "PART_ROWS", 16)
    monkeypatch.setattr(v, "BLOCK_QUERIES", 3)


def test_exact_search_in_parts_and_blocks(spark, small):
    rows = some(1, 150)
    got = found(v.exact_search(frame(spark, rows), v.as_queries(frame(spark, rows), F.col("vec_id") % 10 == 0), 7, 8))
    assert got == plain(rows, range(0, 150, 10), 7)


def test_index_with_every_cell_is_exact_and_takes_new_batches(spark, small, folder):
    rows = some(2, 200)
    v.build_index(frame(spark, rows[:120]), folder, 9, 8)
    v.add_vectors(frame(spark, rows[120:]), folder, "more")
    v.add_vectors(frame(spark, rows[120:]), folder, "more")  # again: replaces itself
    asked = v.as_queries(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert found(v.search_index(spark, folder, asked, 7, 9)) == plain(rows, range(0, 200, 10), 7)
    few = v.search_index(spark, folder, asked, 7, 2)
    assert all(got[0] == q for q, got in found(few).items())
    mean = v.recall(few, v.exact_search(frame(spark, rows), asked, 7, 8)).agg(F.avg("recall")).first()[0]
    assert 0.2 < mean < 1


def test_a_vector_that_a_third_of_the_rows_share(spark, small, folder):
    rows = some(3, 100, copies=150)
    v.build_index(frame(spark, rows), folder, 6, 8)
    got = found(v.search_index(spark, folder, v.as_queries(frame(spark, rows), F.col("vec_id") == 1), 5, 6))
    assert got == {1: [1, 100, 101, 102, 103]}
    sizes = spark.read.parquet(f"{folder}/rows").groupBy("cell").count().agg(F.max("count")).first()[0]
    assert sizes >= 151  # one cell holds them all, and is cut into parts


def test_odd_vectors_and_empty_tables(spark, folder):
    odd = [(500, None), (501, [0.0] * 8), (502, [1.0]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (505, [None] * 8)]
    rows = some(4, 30)
    table = frame(spark, rows + odd)
    v.build_index(table, folder, 4, 8)
    asked = v.as_queries(table, F.col("vec_id") % 10 == 0)
    assert found(v.search_index(spark, folder, asked, 5, 4)) == plain(rows, range(0, 30, 10), 5) == found(v.exact_search(table, asked, 5, 8))
    assert v.exact_search(table.limit(0), asked, 5, 8).collect() == []
    assert v.exact_search(table, asked.limit(0), 5, 8).collect() == []
    v.build_index(table.limit(0), f"{folder}/none", 4, 8)
    assert v.search_index(spark, f"{folder}/none", asked, 5, 4).collect() == []


def test_recall_of_the_registered_index(spark):
    from lumenlog.adapters import Tables
    from lumenlog.plans.search_queries import PROBES, recalls

    got = recalls(Tables(spark, "/root/testdata/sf0.01"), PROBES)
    assert got.agg(F.avg("recall")).first()[0] >= 0.9


def test_exact_search_makes_each_vector_once(spark, small):
    rows = some(5, 60)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def copy(x):
        made.add(1)
        return x

    df = frame(spark, rows).withColumn("embedding", copy("embedding"))
    asked = v.as_queries(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert found(v.exact_search(df, asked, 7, 8)) == plain(rows, range(0, 60, 10), 7)
    assert made.value == len(rows)
