import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import cells
from tests.test_retrieval import brute, ranked

CHUNK = "chunk_id long, embedding array<float>, source string"


def frames(spark, q, c):
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query_vector array<double>")
    chunks = spark.createDataFrame([(i, v.tolist(), f"s{i % 3}") for i, v in enumerate(c)], CHUNK).repartition(4)
    return queries, chunks


@pytest.fixture(scope="module")
def clustered():
    """Forty tight clusters, one of them half of all vectors, many vectors equal, some without a length."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    c = np.concatenate([centres[rng.integers(0, 40, 700)], np.repeat(centres[:1], 600, axis=0)]) + rng.normal(size=(1300, 16)) * 0.05
    c[100:400] = c[100]
    c[7] = c[1200] = 0
    q = centres[rng.integers(0, 40, 30)] + rng.normal(size=(30, 16)) * 0.05
    return q, c.astype(np.float32).astype(float)


@pytest.mark.parametrize("k", [1, 20, 1400])
def test_cells_equal_brute_force(spark, tmp_path, clustered, k, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 7)
    q, c = clustered
    queries, chunks = frames(spark, np.concatenate([q, np.zeros((1, 16))]), c)
    index = cells.build_cells(chunks, str(tmp_path / "index"), block_rows=50)
    found = cells.search_cells(queries, index, k)
    want = brute(q, c, k)
    want[len(q)] = list(range(min(k, len(c))))  # a query without a length scores zero everywhere: the ids decide
    assert ranked(found.hits) == want
    assert index.table("blocks").agg(F.max("rows")).first()[0] <= 50 and index.table("blocks").agg(F.sum("rows")).first()[0] == len(c)


def test_most_cells_are_not_read(spark, tmp_path, clustered):
    q, c = clustered
    queries, chunks = frames(spark, q, c)
    index = cells.build_cells(chunks, str(tmp_path / "index"), block_rows=50)
    found = cells.search_cells(queries, index, 20)
    assert ranked(found.hits) == brute(q, c, 20)
    pairs = found.visits.select("query_id", "cell").distinct().count()
    n_cells, n_rows = index.table("blocks").select("cell").distinct().count(), found.visits.agg(F.sum("rows")).first()[0]
    assert pairs < 0.5 * len(q) * n_cells and n_rows < 0.5 * len(q) * len(c)
    blocks = found.visits.groupBy("query_id", "cell", "block").count()
    assert blocks.where("count > 1").count() == 0  # no block twice


def test_cells_with_a_filter(spark, tmp_path, clustered):
    q, c = clustered
    queries, chunks = frames(spark, q, c)
    index = cells.build_cells(chunks, str(tmp_path / "index"), cells=9, block_rows=64)
    found = cells.search_cells(queries, index, 15, where=F.col("source") == "s1")
    assert ranked(found.hits) == brute(q, c, 15, lambda j: j % 3 == 1)


def test_vectors_without_order(spark, tmp_path):
    """Nothing to prune: every cell is read and the result is still whole."""
    rng = np.random.default_rng(9)
    q, c = rng.normal(size=(5, 12)), rng.normal(size=(400, 12)).astype(np.float32).astype(float)
    queries, chunks = frames(spark, q, c)
    found = cells.search_cells(queries, cells.build_cells(chunks, str(tmp_path / "index")), 10)
    assert ranked(found.hits) == brute(q, c, 10)


def test_nothing_to_search(spark, tmp_path, clustered):
    q, c = clustered
    queries, chunks = frames(spark, q[:2], c[:3])
    empty = cells.build_cells(chunks.where("chunk_id < 0"), str(tmp_path / "empty"))
    assert cells.search_cells(queries, empty, 3).hits.count() == 0
    one = cells.build_cells(chunks, str(tmp_path / "one"))
    assert cells.search_cells(queries.where("query_id < 0"), one, 3).hits.count() == 0
    assert ranked(cells.search_cells(queries, one, 3).hits) == brute(q[:2], c[:3], 3)
    flat = cells.build_cells(chunks.withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), 16)), str(tmp_path / "flat"))
    assert ranked(cells.search_cells(queries, flat, 2).hits) == {0: [0, 1], 1: [0, 1]}
    with pytest.raises(ValueError):
        cells.search_cells(queries.withColumn("query_vector", F.array(F.lit(1.0))), one, 2)
