"""Fingerprints, their links and groups against brute force."""

import os
import random
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import blank_words, corpus, documents  # noqa: E402

from ledgerlight import session  # noqa: E402
from ledgerlight.llm import simhash  # noqa: E402
from ledgerlight.llm.op13 import HASH_SQL, SQL  # noqa: E402
from ledgerlight.llm.op13 import simhash as query  # noqa: E402


def plain_fingerprint(text, n=3):
    w = blank_words(text)
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_components(values, differing=3):
    """The least value reachable, by value."""
    order, root = sorted(values), {v: v for v in values}
    for i, v in enumerate(order):
        for w in order[i + 1:]:
            if (v ^ w).bit_count() <= differing and root[v] != root[w]:
                old, new = max(root[v], root[w]), min(root[v], root[w])
                root = {k: new if r == old else r for k, r in root.items()}
    return root


def by_root(root):
    groups = {}
    for v, r in root.items():
        groups.setdefault(r, set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_bit_counts_of_long_runs():
    rng = np.random.default_rng(1)
    counts = np.array([1, 0, 254, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    got = simhash.fingerprint_runs(hashes, counts)
    at = 0
    for n, f in zip(counts, got):
        mine, at = [int(x) for x in hashes[at:at + n]], at + n
        assert int(f) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mine) > n)


def test_groups_like_brute_force(spark, tmp_path):
    texts = corpus(n=80) + [" ".join(["again"] * 2000), "\x1c odd\x85blank", "İ Ä ß A"]
    ids = [3 * i - 50 for i in range(len(texts))]
    docs = documents(spark, texts, ids=ids).repartition(6)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in query(spark, str(tmp_path)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    root = plain_components(set(prints.values()))
    least = {}
    for i in ids:
        least[root[prints[i]]] = min(i, least.get(root[prints[i]], i))
    assert got == {i: (format(p, "016x"), least[root[p]]) for i, p in prints.items()}


def test_checking_sql_hashes_as_the_library_does():
    import duckdb

    rng = random.Random(1)
    shingles = ["".join(rng.choice("abcdé ü") for _ in range(n)) for n in range(1, 110)] + ["x" * 500]
    con = duckdb.connect()
    con.execute("CREATE TABLE g(s VARCHAR)")
    con.executemany("INSERT INTO g VALUES (?)", [(s,) for s in shingles])
    assert dict(con.execute(f"WITH {HASH_SQL} SELECT s, h FROM hashed").fetchall()) == {
        s: xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles}


def test_query_like_its_sql(spark, tmp_path):
    import duckdb

    docs = documents(spark, corpus(2, n=30), ids=list(range(1000, 1000 + len(corpus(2, n=30))))).select("doc_id", "text")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(f"SELECT doc_id, fingerprint, component_id FROM ({SQL})").fetchall())


@pytest.mark.parametrize("differing", [1, 3, 4])
@pytest.mark.parametrize("small", [1, 64])
def test_links_of_dense_clusters(spark, monkeypatch, differing, small):
    """Clusters around a few values, chains, and values that share a half: no link between components is lost."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(differing)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(90)}
        values |= {centre ^ (rng.getrandbits(32) << 32) for _ in range(40)}
        values |= {centre ^ (1 << b) for b in range(64)} if differing == 3 else set()
    value = rng.getrandbits(64)
    for _ in range(40):
        value ^= sum(1 << b for b in rng.sample(range(64), differing))
        values.add(value)
    rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "finger long")
    links = simhash.near_links(rows, differing).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= differing for r in links)
    root = {v: v for v in values}
    for r in links:
        a, b = root[r["a"] % 2**64], root[r["b"] % 2**64]
        if a != b:
            root = {k: min(a, b) if x == max(a, b) else x for k, x in root.items()}
    assert by_root(root) == by_root(plain_components(values, differing))


def test_variants_meet_once_per_segment():
    places = list(range(64))
    for bits in ([], [3], [3, 40], [1, 2, 60]):
        other = sum(1 << b for b in bits)
        met = 0
        for mask, bit, _ in simhash.variants(places, 0, 3):
            mask, bit = mask % 2**64, bit % 2**64
            met += other & mask == 0 and (bit == 0 or other & bit != 0)
        assert met >= 1


def test_missing_ids_equal_rows_and_nothing(spark):
    docs = documents(spark, ["a b c d", "a b c d", "a b c d", None, "", "q r s"], ids=[4, 4, None, 9, 2, None])
    got = sorted((str(r["doc_id"]), str(r["component"])) for r in simhash.near_fingerprints(docs).collect())
    assert got == sorted([("4", "4"), ("4", "4"), ("None", "4"), ("9", "2"), ("2", "2"), ("None", "None")])
    assert simhash.near_fingerprints(docs.filter("false")).count() == 0


def test_odd_column_names(spark):
    docs = documents(spark, ["a b c", "x"]).withColumnRenamed("text", "a.b").withColumn("finger", F.lit(1))
    assert simhash.near_fingerprints(docs, text="a.b").count() == 2


def test_groups_in_few_files_without_merging_by_adaptive_execution(spark):
    """Small tables make no task a partition: a session of many partitions that are never merged is to end as well."""
    rng = random.Random(7)
    centre, texts = [f"w{rng.randrange(900)}" for _ in range(60)], []
    for _ in range(150):
        own = list(centre)
        own[rng.randrange(60)] = f"v{rng.randrange(900)}"
        texts.append(" ".join(own))
    docs = documents(spark, texts + texts[:20])
    plain = {i: plain_fingerprint(t) for i, t in enumerate(texts + texts[:20])}
    root = plain_components(set(plain.values()))
    least = {}
    for i, p in plain.items():
        least[root[p]] = min(i, least.get(root[p], i))
    before, files, held = len(session._WRITTEN), [], {"spark.sql.shuffle.partitions": "60",
                                                      "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component"] for r in simhash.near_fingerprints(docs).collect()}
        files = [len(spark.read.parquet(p).inputFiles()) for p in session._WRITTEN[before:]]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: least[root[p]] for i, p in plain.items()}
    assert len(files) > 5 and max(files) <= spark.sparkContext.defaultParallelism
