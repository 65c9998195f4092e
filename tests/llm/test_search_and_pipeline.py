"""Top-k search against all scores, the pipeline stage by stage, and the registered queries."""

import collections
import math
import random
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import queries, topk


def _best(rows, picks, k):
    out = {}
    for i, v in rows:
        if i in picks and i not in out:
            scored = sorted((-int(np.dot(v, w)), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize(("size", "shards"), [(3, 10), (400, 64)])
def test_max_score(spark, monkeypatch, size, shards):
    monkeypatch.setattr(topk, "SHARD_VECTORS", shards)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(x) for x in rng.integers(-8, 9, 6) / 256]) for i in range(size)]
    rows += [(1000 + i, rows[1][1]) for i in range(9)] + [(2000, [0.0] * 6), (2001, [-x for x in rows[0][1]])]
    odd = [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3002, [math.nan] * 6), (3003, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id bigint, embedding array<float>, id int, v int")
    got = collections.defaultdict(list)
    for r in topk.max_score(df, F.col("vec_id") % 2 == 0, k=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = _best(whole, {i for i, _ in rows if i % 2 == 0}, 5)
    assert {q: [x[1:] for x in sorted(r)] for q, r in got.items()} == want
    assert all([x[0] for x in sorted(r)] == list(range(1, len(r) + 1)) for r in got.values())
    assert topk.max_score(df.limit(0), F.lit(True)).collect() == []


def test_search_leaves_terms_out():
    """The threshold makes weak terms non-essential, and the result stays exact."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 32))
    vectors = np.floor(256 * (centre[rng.integers(0, 5, 2000)] + rng.normal(scale=0.2, size=(2000, 32)))).astype(np.int64)
    shard = topk.Shard(np.arange(2000), vectors)
    for q in range(0, 2000, 97):
        at, score = shard.top(vectors[q], q, 5)
        all_ = vectors @ vectors[q]
        all_[q] = -(1 << 60)
        order = np.lexsort((np.arange(2000), -all_))[:5]
        assert at.tolist() == order.tolist() and score.tolist() == all_[order].tolist()


def _documents(spark):
    rows = list({r[0]: r for r in cases.documents(9) if r[0] is not None}.values())
    return rows, cases.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def test_stages_against_plain_versions(spark):
    rows, docs = _documents(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_join", "mixing", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    out = stage["language_id"](spark, docs, "")
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and ids == {i for i, x, _, _ in rows if x and any(c.isalpha() for c in x)}

    out = stage["exact_dedup"](spark, docs, "")
    first = {}
    for i, x, _, _ in rows:
        x = re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
        first[x] = min(first.get(x, i), i)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(first.values())

    out = stage["ngram_join"](spark, docs, "")
    sets = {}
    for i, x, _, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i in sets if label[i] == i}

    out = stage["mixing"](spark, docs, "")
    assert out.columns == docs.columns and max(collections.Counter(r.doc_id for r in out.collect()).values()) <= 3
    out = stage["best_fit_packing"](spark, docs, "")
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}


def test_pipeline_runs(spark, folder):
    _, docs = _documents(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert per and max(r.n for r in per) <= 1024
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []


def test_clean_documents_stay(spark):
    """Different texts, each of one language: only the mix may leave some out."""
    rng = random.Random(8)
    docs = cases.table(spark, [(i, cases.sentence(rng, 80), "en", "s") for i in range(50)]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.count() == 50, name


def test_registered_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_small_tables_and_batches_keep_executors_small(spark, monkeypatch):
    """Tables of the driver's rows need no Python workers of their own, and the pipeline's stages hand on small batches."""
    import corpus_pipeline
    from pyspark.sql import SparkSession

    from lumenlog.session import local_table

    rows = [(1, None, 1 << 40, 0.5), (2, "é\x00", None, 1e300)]
    table = local_table(spark, rows, "sid int, source string, n bigint, t double")
    assert [tuple(r) for r in table.collect()] == rows and table.dtypes == [("sid", "int"), ("source", "string"), ("n", "bigint"), ("t", "double")]
    assert local_table(spark, [], "sid int, source string").collect() == []
    docs = spark.createDataFrame([(i, "abc def ghi " * i, "en", f"s{i % 3}") for i in range(1, 30)], "doc_id bigint, text string, lang string, source string")
    scans, create = [], SparkSession.createDataFrame

    def created(self, *args, **kwargs):
        made = create(self, *args, **kwargs)
        scans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(SparkSession, "createDataFrame", created)
    corpus_pipeline.languages(spark, docs, "").count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    corpus_pipeline.source_mix(spark, docs, "").count()
    assert len(scans) >= 3 and all("LocalTableScan" in s and "ExistingRDD" not in s for s in scans)
