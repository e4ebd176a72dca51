import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import bm25
from tests.llm.fixtures import corpus, documents, plain_words


def ranked(texts, ids, asks, k):
    """The best k of each query by brute force, null ids last."""
    words = [plain_words(t or "") for t in texts]
    df = Counter(w for x in words for w in set(x))
    mean, tfs = sum(map(len, words)) / len(words), [Counter(x) for x in words]
    out = []
    for q in asks:
        scores = []
        for d, tf in enumerate(tfs):
            s = sum(math.log(1 + (len(texts) - df[w] + .5) / (df[w] + .5)) * tf[w] * 2.2
                    / (tf[w] + 1.2 * (.25 + .75 * len(words[d]) / mean)) for w in tfs[q] if w in tf)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), ids[d] is None, ids[d] or 0, ids[d]))
        out += [(ids[q], rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return out


def rows_made(df, node):
    """Rows that came out of the nodes of this name, in a plan that has run."""
    plans, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        if plan.nodeName() == node:
            rows += plan.metrics().apply("pythonNumRowsReceived").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return rows


def test_search_rows_follow_the_queries_and_not_the_shards(spark):
    """Each shard once gave its best k for each query, so rows grew with queries times shards."""
    slots, k = spark.sparkContext.defaultParallelism, 3
    docs = documents(spark, corpus(5, n=40 * slots, vocabulary=120)).repartition(6 * slots)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan that runs is then the one that is read
    try:
        got = bm25.top_documents(docs, F.col("doc_id") % 10 == 0, k, shard_bytes=100)
        asks = len({r["query_id"] for r in got.collect()})
        assert asks and rows_made(got, "MapInArrow") <= asks * k * slots
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_search_ranks_equals_by_id_across_shards(spark, k):
    rng = random.Random(3)
    some = corpus(6, n=30, vocabulary=60)
    texts = some + [some[3]] * 25 + [some[4]] * 3 + ["", None, "?!"]
    ids = rng.sample(range(-200, 200), len(texts))
    ids[40] = None
    docs = documents(spark, texts, ids=ids).repartition(7)
    got = bm25.top_documents(docs, F.col("doc_id") % 3 == 0, k, shard_bytes=100, group_bytes=400).collect()
    want = ranked(texts, ids, [i for i, d in enumerate(ids) if d is not None and d % 3 == 0], k)
    got = sorted(((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=lambda r: r[:2])
    want.sort(key=lambda r: r[:2])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


@pytest.mark.parametrize("common,room,block,short", [(16, 64 << 20, 64, 64), (2, 64 << 20, 2, 0), (1000, 2000, 4, 1), (16, 0, 64, 64)])
def test_search_bounds_lose_nothing(spark, monkeypatch, common, room, block, short):
    """Whatever is kept as columns, and however small the blocks that are passed over."""
    for name, value in (("COMMON", common), ("COLUMN_BYTES", room), ("BLOCK_DOCS", block), ("SHORT_LIST", short), ("QUERIES_AT_ONCE", 5)):
        monkeypatch.setattr(bm25, name, value)
    texts = corpus(9, n=150, vocabulary=300) + ["abc"] * 4
    n, k = len(texts), 3
    words = [plain_words(t) for t in texts]
    number = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    holders = Counter(w for x in words for w in set(x))
    keys = [np.array(sorted(number[w] for w in set(x)), dtype=np.uint64) for x in words]
    counts = np.array([holders[w] for w in sorted(number)])
    flat = np.concatenate(keys).astype(np.int64)
    idf = np.log1p((n - counts[flat] + 0.5) / (counts[flat] + 0.5))
    queries = bm25.Queries(list(range(n)), np.cumsum([len(x) for x in keys]).tolist(), np.concatenate(keys), idf)
    best, mean = bm25.Best(n, k), sum(map(len, words)) / n
    for places in np.array_split(np.arange(n), 4):
        own = sorted({w for p in places for w in words[p]})
        local, tfs = {w: i for i, w in enumerate(own)}, [Counter(words[p]) for p in places]
        row = {"lists": [{"keys": bm25.pack_sorted(np.array([number[w] for w in own], dtype=np.uint64))}],
               "lengths": bm25.pack_counts(np.array([len(words[p]) for p in places])),
               "sizes": bm25.pack_counts(np.array([len(t) for t in tfs])),
               "terms": bm25.pack_counts(np.array([local[w] for t in tfs for w in sorted(t)])),
               "tf": bm25.pack_counts(np.array([t[w] for t in tfs for w in sorted(t)]))}
        bm25._search(row, pa.array(places), queries, mean, best)
    ask, place, score = best.rows()
    got = sorted(zip(ask.tolist(), (-score).tolist(), best.ids.take(pa.array(place)).to_pylist()))
    want = sorted((q, -s, d) for q, _, d, s in ranked(texts, list(range(n)), range(n), k))
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-6)
