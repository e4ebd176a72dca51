import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import retrieval as ret


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(7, 16)), rng.normal(size=(300, 16))
    c[10] = c[20] = c[200]  # equal vectors: the id decides
    c[30] = 0.0
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query_vector array<double>")
    chunks = spark.createDataFrame([(i, v.tolist(), f"s{i % 3}") for i, v in enumerate(c)],
                                   "chunk_id long, embedding array<float>, source string").repartition(5)
    return q, c.astype(np.float32).astype(float), queries, chunks


def brute(q, c, k, keep=lambda i: True):
    norm = np.linalg.norm(c, axis=1)
    unit = np.divide(c, norm[:, None], out=np.zeros_like(c), where=norm[:, None] > 0)
    out = {}
    for i, v in enumerate(q):
        s = np.round(unit @ (v / np.linalg.norm(v)), 12)
        out[i] = [j for j in sorted(range(len(c)), key=lambda j: (-s[j], j)) if keep(j)][:k]
    return out


def ranked(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    return got


@pytest.mark.parametrize("limit", [ret.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("k", [1, 10, 400])
def test_knn_equals_brute_force(vectors, limit, k, monkeypatch):
    monkeypatch.setattr(ret, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(ret, "BLOCK_CHUNKS", 80)
    q, c, queries, chunks = vectors
    assert ranked(ret.knn(queries, chunks, k, broadcast_bytes=limit)) == brute(q, c, k)


def test_knn_source_filter(vectors):
    q, c, queries, chunks = vectors
    got = ranked(ret.knn(queries, chunks, 5, where=F.col("source") == "s1"))
    assert got == brute(q, c, 5, lambda j: j % 3 == 1)


def test_knn_without_queries(vectors):
    _q, _c, queries, chunks = vectors
    assert ret.knn(queries.where("query_id < 0"), chunks, 5).count() == 0


def hits(spark, *rows):
    return spark.createDataFrame([(1, i + 1, s, t) for i, (s, t) in enumerate(rows)], "query_id int, rank int, score double, chunk_content string")


def test_threshold(spark):
    df = hits(spark, (0.9, "a"), (0.8, "b"), (0.2, "c"))
    assert ret.min_score(df).count() == 2 and ret.min_score(df, 0).count() == 3


def test_dedup_keeps_the_first(spark):
    df = hits(spark, (0.9, "Q3 revenue was up ten percent"), (0.8, "q3 Revenue was UP ten percent"), (0.7, "something else"), (0.6, ""), (0.5, ""))
    kept = [r["rank"] for r in ret.dedup_hits(df, 0.9).orderBy("rank").collect()]
    assert kept == [1, 3, 4, 5]
    again = ret.dedup_hits(ret.dedup_hits(df, 0.9), 0.9)
    assert [r["rank"] for r in again.orderBy("rank").collect()] == kept


def test_dedup_compares_with_kept_hits_only(spark):
    # b is a copy of a and dropped; c is a copy of b but not of a, so it stays.
    a, b, c = "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 9 10"
    kept = [r["rank"] for r in ret.dedup_hits(hits(spark, (3.0, a), (2.0, b), (1.0, c)), 0.85).orderBy("rank").collect()]
    assert kept == [1, 3]


def test_metadata_filter(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], ["k", "v"])
    allowed, cols = {"k": ["a", "b"]}, {"k": F.col("k"), "v": F.col("v")}

    def rows(filters):
        p = ret.metadata_filter(filters, allowed, cols)
        return None if p is None else sorted(r.v for r in df.where(p).collect())

    assert rows({}) is None and rows({"v": 1}) is None and rows({"k": "c"}) is None and rows({"k": ["c", "d"]}) is None
    assert rows({"k": "a"}) == [1] and rows({"k": ["a", "c"]}) == [1] and rows({"k": ["a", "b"], "v": 9}) == [1, 2]


def test_rerank(spark):
    df = hits(spark, (0.9, "one two"), (0.8, "three four"), (0.7, "three")).withColumn("question", F.lit("three four five"))
    got = ret.rerank(df, ret.overlap_score(), 2).orderBy("rank").collect()
    assert [r.chunk_content for r in got] == ["three four", "three"] and got[0].score == pytest.approx(2 / 3)
    assert [r["rank"] for r in ret.rerank(df, None, 2).orderBy("rank").collect()] == [1, 2]


def test_retrieve_runs_every_step(spark):
    from ledgerlight.operators import documents as docs
    texts = ["net revenue rose in the third quarter", "net revenue rose in the third quarter", "holiday policy for staff", "x " * 700]
    base = spark.createDataFrame([(i, "s", t, None) for i, t in enumerate(texts)], "document_id int, source string, text string, title string")
    chunks = docs.embed(docs.chunk_recursive(base))
    queries = docs.hashed_terms(spark.createDataFrame([(1, "third quarter net revenue")], ["query_id", "question"]), "question", "query_vector")
    out = ret.retrieve(queries, chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"], r.title) for r in out] == [("0-0", 1, "Unknown")]
    stats = ret.retrieval_stats(ret.retrieve(queries, chunks, ret.RetrievalConfig(dedup=False, rerank=True)), 256, True).first()
    assert stats.retrieved_count == 2 and stats.reranked and stats.top_scores == [1.0, 1.0]
