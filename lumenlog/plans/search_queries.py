"""Named queries: vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.adapters import ORACLE_VIEWS
from lumenlog.functions.vectors import usable
from lumenlog.operators import postings
from lumenlog.operators import search as s
from lumenlog.operators import vector_index as v
from lumenlog.operators.textprep import embed
from lumenlog.plans.registry import query, r, rounded
from lumenlog.plans.shapes import documents
from lumenlog.session import scratch_path

COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
ORACLE_VIEWS["scores"] = f"""
SELECT q.vec_id AS query_id, v.vec_id, v.project_id, v.severity, v.service_name, v.trace_id, v.ts, {COS} AS score FROM vec AS v, (SELECT vec_id, embedding FROM vec WHERE vec_id < 5) AS q
"""
ORACLE_VIEWS["all_scores"] = f"""
SELECT q.vec_id AS query_id, v.vec_id, {COS} AS score FROM vec AS v, (SELECT vec_id, embedding FROM vec WHERE vec_id % 100 = 0) AS q
"""
S = r("score", 5)
#: Cells of the stored index and how many a query looks into; the vectors here are nearly random, so it takes most of them.
CELLS, PROBES = 64, 48
#: Makes one number of a conversation and a turn.
MOST_TURNS = 1 << 20


def query_vectors(c) -> dict[int, list[float]]:
    """The five fixed query vectors; five rows, whatever the corpus holds."""
    rows = c.embeddings.filter(F.col("vec_id") < 5).select("vec_id", "embedding").collect()
    return {row["vec_id"]: list(row["embedding"]) for row in rows}


def score5(df):
    return rounded(df, "score", digits=5)


@query("drop_zero_vectors", "SELECT vec_id FROM vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def _(c):
    return c.vec.filter(usable("embedding", 64)).select("vec_id")


@query(
    "semantic_search",
    f"SELECT vec_id, severity, service_name, {S} AS score FROM scores WHERE query_id = 0 AND project_id = 'tenant-0' AND score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10",
)
def _(c):
    rows = s.filters(c.vec, {"project_id": "tenant-0"})
    return score5(s.semantic_search(rows, query_vectors(c)[0], 10, 0.1, payload=["severity", "service_name"]))


@query(
    "filtered_search",
    f"SELECT vec_id, {S} AS score FROM scores WHERE query_id = 1 AND severity = 'INFO' AND project_id = 'tenant-2' AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00' ORDER BY score DESC, vec_id LIMIT 10",
)
def _(c):
    rows = s.filters(c.vec, {"severity": "INFO", "project_id": "tenant-2"}, "2024-01-02 00:00:00", "2024-01-28 00:00:00")
    return score5(s.semantic_search(rows, query_vectors(c)[1], 10, None))


BATCH = "SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores"


ALL_BATCH = BATCH.replace("FROM scores", "FROM all_scores")


def all_queries(c):
    """A hundredth of the vectors."""
    return v.as_queries(c.vec, F.col("vec_id") % 100 == 0)


#: What was indexed in this session, by kind and data folder.
_INDEXED: dict[tuple[str, str, str], str] = {}


def indexed(c, kind: str, build) -> str:
    """The path of an index, which is built when it is first asked for and then serves all queries of the session."""
    key = (kind, c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _INDEXED:
        path = scratch_path(c.spark, kind)
        build(path)
        _INDEXED[key] = path
    return _INDEXED[key]


def stored_index(c) -> str:
    """The vectors in two batches, as an index is built once and then extended."""

    def build(path: str) -> None:
        late = F.col("vec_id") % 10 == 3
        v.build_index(c.vec.filter(~late), path, CELLS, 64)
        v.add_vectors(c.vec.filter(late), path, "second")

    return indexed(c, "vector-index", build)


@query("batch_search", f"SELECT query_id, vec_id, rank, {S} AS score FROM ({ALL_BATCH}) AS b WHERE rank <= 10")
def _(c):
    return score5(v.exact_search(c.vec, all_queries(c), 10, 64))


@query(
    "search_groups",
    f"""WITH h AS (SELECT vec_id, trace_id, score, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores WHERE query_id = 0),
        g AS (SELECT trace_id, score AS group_score FROM h WHERE rank = 1 ORDER BY score DESC, vec_id LIMIT 5)
        SELECT h.trace_id, vec_id, {S} AS score, rank, {r('group_score', 5)} AS group_score FROM h JOIN g ON h.trace_id = g.trace_id WHERE rank <= 3""",
)
def _(c):
    return rounded(s.search_groups(c.vec, query_vectors(c)[0], "trace_id", 3, 5), "score", "group_score", digits=5)


@query(
    "rank_fusion",
    f"""WITH b AS ({BATCH}), l AS (SELECT vec_id, rank FROM b WHERE query_id IN (0, 1) AND rank <= 20) SELECT vec_id, {r('sum(1.0 / (2 + rank))', 5)} AS score FROM l GROUP BY 1 ORDER BY sum(1.0 / (2 + rank)) DESC, vec_id LIMIT 10""",
)
def _(c):
    q = query_vectors(c)
    return score5(s.rrf([s.batch_search(c.vec, {0: q[0]}, 20), s.batch_search(c.vec, {1: q[1]}, 20)], 10))


@query(
    "fusion_by_distribution",
    f"""WITH b AS ({BATCH}), l AS (SELECT query_id, vec_id, score FROM b WHERE query_id IN (0, 1) AND rank <= 20), m AS (SELECT query_id, avg(score) AS m, stddev_samp(score) AS d FROM l GROUP BY 1),
        p AS (SELECT vec_id, least(1.0, greatest(0.0, (score - (m - 3 * d)) / (6 * d))) AS part FROM l JOIN m ON l.query_id = m.query_id)
        SELECT vec_id, {r('sum(part)', 5)} AS score FROM p GROUP BY 1 ORDER BY sum(part) DESC, vec_id LIMIT 10""",
)
def _(c):
    q = query_vectors(c)
    return score5(s.dbsf([s.batch_search(c.vec, {0: q[0]}, 20), s.batch_search(c.vec, {1: q[1]}, 20)], 10))


def bm25_sql(words: list[str], k: int) -> str:
    """BM25 of the documents for a few words, ranked."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    parts = [f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * c.len / avg_len))" for i in range(len(words))]
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return rf"""d AS (SELECT doc_id AS vec_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x <> '') AS t FROM documents),
        c AS (SELECT vec_id, len(t) AS len, {tf} FROM d), st AS (SELECT count(*) AS n, avg(len) AS avg_len, {df} FROM c),
        b AS (SELECT vec_id, {' + '.join(parts)} AS score FROM c, st WHERE {hit}),
        sparse AS (SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM b ORDER BY score DESC, vec_id LIMIT {k})"""


@query(
    "hybrid_search",
    f"""WITH {bm25_sql(["the", "of", "error"], 20)}, l AS (SELECT vec_id, rank FROM ({BATCH}) AS x WHERE query_id = 0 AND rank <= 20 UNION ALL SELECT vec_id, rank FROM sparse WHERE rank <= 20)
        SELECT vec_id, {r('sum(1.0 / (2 + rank))', 5)} AS score FROM l GROUP BY 1 ORDER BY sum(1.0 / (2 + rank)) DESC, vec_id LIMIT 10""",
)
def _(c):
    sparse = keyword_hits(c, c.benchmark.limit(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, ["the", "of", "error"])).alias("words")), 20)
    return score5(s.hybrid_search(c.vec, query_vectors(c)[0], sparse, 10))


def keyword_hits(c, queries, k: int):
    """Hits over the documents' postings, which are stored in two batches."""

    def build(path: str) -> None:
        late = F.col("doc_id") % 5 == 2
        postings.add_documents(documents(c).filter(~late), path, "doc_id", "text", "first")
        postings.add_documents(documents(c).filter(late), path, "doc_id", "text", "second")

    return postings.search(c.spark, indexed(c, "postings", build), queries, k)


@query("sparse_search", f"WITH {bm25_sql(['the', 'with', 'http'], 20)} SELECT vec_id, {S} AS score, rank FROM sparse")
def _(c):
    asked = c.benchmark.limit(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, ["the", "with", "http"])).alias("words"))
    return score5(keyword_hits(c, asked, 20).drop("query_id"))


SPLIT = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')"


@query(
    "sparse_search_many",
    f"""WITH d AS (SELECT doc_id AS vec_id, {SPLIT} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
        p AS (SELECT vec_id, len, term, count(*) AS tf FROM (SELECT vec_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY 1, 2, 3), lx AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        q AS (SELECT DISTINCT conv_id AS query_id, unnest({SPLIT}) AS term FROM conversations WHERE turn = 0),
        h AS (SELECT query_id, vec_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN lx ON lx.term = q.term JOIN p ON p.term = q.term, st GROUP BY 1, 2),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM h) SELECT query_id, rank, {S} AS score FROM k WHERE rank <= 10""",
)
def _(c):
    """The first turn of every conversation asks. Near copies tie but for the last bits, so only ranks and scores are compared."""
    asked = c.conversations.filter("turn = 0").select(F.col("conv_id").alias("query_id"), postings.terms("text").alias("words"))
    return score5(keyword_hits(c, asked, 10)).select("query_id", "rank", "score")


@query(
    "formula_rescore",
    f"""SELECT vec_id, {S} AS score, {r("0.8 * score + 0.2 * CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END", 5)} AS final_score FROM scores WHERE query_id = 2
        ORDER BY 0.8 * score + 0.2 * CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END DESC, vec_id LIMIT 10""",
)
def _(c):
    rows = s.formula_rescore(c.vec, query_vectors(c)[2], "0.8 * score + 0.2 * CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END", 10)
    return rounded(rows.select("vec_id", "score", "final_score"), "score", "final_score", digits=5)


@query("paged_search", f"SELECT vec_id, {S} AS score FROM scores WHERE query_id = 3 ORDER BY score DESC, vec_id LIMIT 10 OFFSET 20")
def _(c):
    return score5(s.semantic_search(c.vec, query_vectors(c)[3], 10, None, offset=20))


@query("search_errors", f"SELECT vec_id, {S} AS score FROM scores WHERE query_id = 4 AND severity = 'ERROR' AND service_name = 'svc-0' AND ts >= TIMESTAMP '2024-01-01 00:00:00' ORDER BY score DESC, vec_id LIMIT 10")
def _(c):
    rows = s.filters(c.vec, {"severity": "ERROR", "service_name": "svc-0"}, start="2024-01-01 00:00:00")
    return score5(s.semantic_search(rows, query_vectors(c)[4], 10, None))


@query("scroll", "SELECT vec_id, project_id, severity FROM vec WHERE severity = 'ERROR' AND vec_id > 20 ORDER BY vec_id LIMIT 50")
def _(c):
    return s.scroll(s.filters(c.vec, {"severity": "ERROR"}), 50, after=20).select("vec_id", "project_id", "severity")


@query("collection_stats", "SELECT count(*) AS points, CAST(max(len(embedding)) AS INTEGER) AS dim, count(DISTINCT project_id) AS project_id_values, count(DISTINCT severity) AS severity_values FROM vec")
def _(c):
    return s.collection_stats(c.vec, ["project_id", "severity"])


@query(
    "distances",
    f"""SELECT v.vec_id, {r(COS, 5)} AS cosine, {r('list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))', 5)} AS dot,
        {r('list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))', 5)} AS euclid FROM vec AS v, (SELECT embedding FROM vec WHERE vec_id = 0) AS q""",
)
def _(c):
    return rounded(s.distances(c.vec, query_vectors(c)[0]), "cosine", "dot", "euclid", digits=5)


@query("ann_search")
def _(c):
    return score5(v.search_index(c.spark, stored_index(c), all_queries(c), 10, PROBES))


@query("ann_search_all_cells", f"SELECT query_id, vec_id, rank, {S} AS score FROM ({ALL_BATCH}) AS b WHERE rank <= 10")
def _(c):
    return score5(v.search_index(c.spark, stored_index(c), all_queries(c), 10, CELLS))


def recalls(c, probes: int):
    return v.recall(v.search_index(c.spark, stored_index(c), all_queries(c), 10, probes), v.exact_search(c.vec, all_queries(c), 10, 64))


@query("recall_at_k")
def _(c):
    return recalls(c, PROBES)


@query("recall_reaches_target", "SELECT count(*) AS queries, true AS reached FROM vec WHERE vec_id % 100 = 0")
def _(c):
    return recalls(c, PROBES).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


def document_vectors(c):
    rows = documents(c).select("doc_id", "text", "source", F.sha2("text", 256).alias("text_hash"))
    return embed(rows, "text", dim=64).withColumn("vec_id", F.col("doc_id"))


@query("similar_logs")
def _(c):
    docs = document_vectors(c)
    # A text stands once among the candidates, so dropping the query's own text leaves enough of the others.
    first = docs.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    asked = v.as_queries(docs, F.col("doc_id") % 100 == 0)
    hits = v.exact_search(docs.join(first, ["text_hash", "doc_id"], "left_semi"), asked, 11, 64).select("query_id", "vec_id", "score")
    hashes = docs.select("vec_id", "text_hash", "source")
    own = hashes.select(F.col("vec_id").alias("query_id"), F.col("text_hash").alias("own_hash"))
    others = hits.join(hashes, "vec_id").join(own, "query_id").filter("text_hash <> own_hash").drop("own_hash")
    return s.ranked(others, 10)


@query("memory_search")
def _(c):
    rows = c.conversations.select(F.concat(F.lit("tenant-"), F.col("conv_id") % 3).alias("tenant"), "conv_id", "turn", "role", "text")
    rows = rows.withColumn("vec_id", F.col("conv_id") * MOST_TURNS + F.col("turn"))
    asked = v.as_queries(embed(rows.filter("conv_id = 0 AND turn = 0"), "text", dim=64), F.lit(True))
    hits = v.exact_search(embed(s.filters(rows, {"tenant": "tenant-0", "role": "user"}), "text", dim=64), asked, 10, 64)
    return hits.select(F.floor(F.col("vec_id") / MOST_TURNS).alias("conv_id"), (F.col("vec_id") % MOST_TURNS).alias("turn"), "rank", "score")


@query("retrieval_context")
def _(c):
    docs = document_vectors(c)
    asked = v.as_queries(embed(c.benchmark, "text", dim=64), F.lit(True), "item_id")
    hits = v.exact_search(docs, asked, 5, 64)
    return hits.join(docs.select("vec_id", "source", F.substring("text", 1, 500).alias("preview")), "vec_id")
