"""Sequence, quantile and search helpers against brute force, with one key holding much of the data."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.functions import ordered
from lumenlog.functions.stats import exact_quantiles
from lumenlog.operators import postings
from lumenlog.operators import search as s

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    rows, at = [], {}
    for _ in range(900):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"
        at[key] = at.get(key, -1) + 1
        rows.append((key, at[key], rng.randrange(100), rng.randrange(5000)))
    return rows


@pytest.mark.parametrize(("block", "levels"), [(3, 2), (7, 1), (4096, 2)])
def test_running_sum(spark, skewed, block, levels):
    df = spark.createDataFrame(skewed, "k string, pos long, v long, sec long")
    got = {(r["k"], r["pos"]): r["total"] for r in ordered.running_sum(df, ["k"], "pos", "v", "total", block, levels).collect()}
    sums, expected = {}, {}
    for k, pos, v, _ in skewed:
        sums[k] = sums.get(k, 0) + v
        expected[(k, pos)] = sums[k]
    assert got == expected


def test_rolling_rows(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, pos long, v long, sec long")
    rows = ordered.rolling_rows(df, ["k"], "pos", 5, {"hi": F.max("v"), "n": F.count("*")}, block=8).collect()
    by_key = {}
    for k, _, v, _ in skewed:
        by_key.setdefault(k, []).append(v)
    assert len(rows) == len(skewed)
    for r in rows:
        window = by_key[r["k"]][max(0, r["pos"] - 4) : r["pos"] + 1]
        assert (r["hi"], r["n"]) == (max(window), len(window))


def test_rolling_seconds(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, pos long, v long, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    rows = ordered.rolling_seconds(df, ["k"], "ts", 60, {"n": F.count("*")}, block=100).collect()
    assert len(rows) == len(skewed)
    for r in rows:
        assert r["n"] == sum(1 for k, _, _, sec in skewed if k == r["k"] and r["sec"] - 60 <= sec <= r["sec"])


def test_positions(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, pos long, v long, sec long")
    placed = ordered.with_position(df, [F.col("sec"), F.col("k"), F.col("pos")]).collect()
    order = sorted(skewed, key=lambda x: (x[3], x[0], x[1]))
    assert [(r["k"], r["pos"]) for r in sorted(placed, key=lambda r: r["position"])] == [(k, p) for k, p, _, _ in order]
    inside = ordered.with_key_position(df, ["k"], [F.col("pos")]).collect()
    assert all(r["position"] == r["pos"] for r in inside)


@pytest.mark.parametrize("slack", [40, 1000, 100_000])
def test_exact_quantiles(spark, slack):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.choice([1.5, 2.0, rng.random() * 9, rng.gauss(50, 20)])) for _ in range(1500)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95, "p05": 0.05}, slack).collect()
    assert {r["k"] for r in got} == {k for k, v in rows if v is not None}
    for r in got:
        values = [v for k, v in rows if k == r["k"] and v is not None]
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p05", 0.05)):
            assert math.isclose(r[name], float(np.quantile(values, q)), rel_tol=1e-12), (r["k"], name)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = rows.collect()
    return rows, np.array([r["embedding"] for r in local]), np.array([r["vec_id"] for r in local])


def test_batch_search(spark, corpus):
    rows, vectors, ids = corpus
    queries = {int(ids[i]): vectors[i].tolist() for i in range(3)}
    got = s.batch_search(rows, queries, 7).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i in range(3):
        expected = np.lexsort((ids, -(unit @ unit[i])))[:7]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == ids[i]), key=lambda r: r["rank"])] == ids[expected].tolist()


def test_zero_vectors_are_left_out(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in s.semantic_search(df, [1.0, 0.0], 5, None).collect()] == [2]


def test_sparse_search(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = ["the", "error"]
    for batch in (0, 1, 1):
        postings.add_documents(docs.filter(F.col("doc_id") % 2 == batch), folder, "doc_id", "text", str(batch))
    asked = spark.createDataFrame([(7, [*words, "the", "nowhere"]), (8, ["nowhere"])], "query_id int, words array<string>")
    hits = postings.search(spark, folder, asked, 15).collect()
    assert {r["query_id"] for r in hits} == {7}
    got = [(r["vec_id"], round(r["score"], 9)) for r in sorted(hits, key=lambda r: r["rank"])]
    texts = {r["doc_id"]: [w for w in re.split(r"[^\w]+", r["text"].lower()) if w] for r in docs.collect()}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    scores = {}
    for doc, tokens in texts.items():
        total = 0.0
        for w in words:
            df = sum(1 for t in texts.values() if w in t)
            tf = tokens.count(w)
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / avg))
        if total > 0:
            scores[doc] = total
    expected = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:15]
    assert got == [(d, round(v, 9)) for d, v in expected]


def test_many_searches_in_shards_and_blocks(spark, folder, monkeypatch):
    """Many queries against all scores; ids that repeat, and queries that repeat, add up."""
    rng = np.random.default_rng(5)
    texts = [(int(i), " ".join(f"w{min(40, rng.zipf(1.3))}" for _ in range(rng.integers(1, 60)))) for i in range(300)] + [(3, "w1 w2 w39"), (4, None)]
    asked = [(int(i % 70) if i else None, [f"w{x}" for x in rng.integers(1, 42, 6)]) for i in range(90)]
    for name, most in (("SHARD_DOCUMENTS", 37), ("BLOCK_QUERIES", 30), ("STORED_PAIRS", 16), ("COUNTED_TERMS", 100)):
        monkeypatch.setattr(postings, name, most)
    postings.add_documents(spark.createDataFrame(texts, "doc_id int, text string"), folder, "doc_id", "text", "0")
    hits = postings.search(spark, folder, spark.createDataFrame(asked, "query_id int, words array<string>"), 5).collect()
    split = [(i, (t or "").split()) for i, t in texts]
    n, avg = len(split), sum(len(t) for _, t in split) / len(split)
    df = {w: sum(w in t for _, t in split) for _, t in split for w in t}
    scores = {}
    for q, words in asked:
        for w in set(words) & set(df):
            for i, t in split:
                if c := t.count(w):
                    part = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / avg))
                    scores.setdefault(q, {}).setdefault(i, []).append(part)
    for q, all_ in scores.items():
        best = sorted((-round(sum(v), 9), i) for i, v in all_.items())[:5]
        got = [(-round(r["score"], 9), r["vec_id"]) for r in sorted((r for r in hits if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == best, q
    assert {r["query_id"] for r in hits} == set(scores)


def test_postings_are_moved_once_for_all_blocks_of_queries(spark, folder, monkeypatch):
    """What a search stores are the asked postings, each once, and at most k rows of a task for a query; no copy for a block or a shard."""
    import pyarrow as pa

    docs, queries = 200, 90
    postings.add_documents(spark.createDataFrame([(i, f"w{i % 7} w{i % 11} both rare{i}") for i in range(docs)], "doc_id int, text string"), folder, "doc_id", "text", "0")
    asked = spark.createDataFrame([(i, [f"w{i % 7}", "both", "nowhere"]) for i in range(queries)], "query_id int, words array<string>")
    for name, most in (("SHARD_DOCUMENTS", 20), ("BLOCK_QUERIES", 10), ("MOST_TASKS", 3)):
        monkeypatch.setattr(postings, name, most)
    kept, materialize = {}, postings.materialize
    monkeypatch.setattr(postings, "materialize", lambda df, label: kept.update({label: materialize(df, label)}) or kept[label])
    hits = postings.search(spark, folder, asked, 4)
    assert hits.count() == 4 * queries
    stored = [pa.ipc.open_stream(bytes(r["postings"])).read_all().num_rows for r in kept["shards"].collect()]
    assert len(stored) > 5 and sum(stored) == sum(len({f"w{i % 7}", f"w{i % 11}", "both"} & {f"w{j}" for j in range(7)}) + 1 for i in range(docs))
    assert postings.search(spark, folder, asked.limit(0), 4).collect() == []


def test_hybrid_fusion(spark, corpus):
    rows, vectors, ids = corpus
    sparse = spark.createDataFrame([(int(ids[9]), 3.0, 1), (int(ids[0]), 2.0, 2)], "vec_id long, score double, rank int")
    got = s.hybrid_search(rows, vectors[0].tolist(), sparse, 2).collect()
    assert got[0]["vec_id"] == ids[0] and math.isclose(got[0]["score"], 1 / 3 + 1 / 4)
    both = s.hybrid_search(rows, vectors[0].tolist(), sparse, 2, fusion="dbsf").collect()
    assert len(both) == 2 and both[0]["score"] >= both[1]["score"]
