"""Eigenpairs against a direct solve, and whitening on awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import eigen
from ledgerlight.llm.op12 import whitening
from ledgerlight.llm.whitening import whiten

RNG = np.random.default_rng(3)


def largest(matrix, wanted):
    found = [eigen.solve_slice(matrix, s) for s in eigen.slices_of_largest(matrix, wanted)]
    return eigen.merge_slices(matrix, found, wanted)


def spectra():
    for size in (1, 2, 7, 40):
        turn = np.linalg.qr(RNG.standard_normal((size, size)))[0]
        for values in (RNG.uniform(1, 2, size), np.where(np.arange(size) < size / 2, 7.0, 0.0), np.full(size, 3.0),
                       10.0 ** -np.arange(size), np.concatenate([[1e6], RNG.uniform(0.99, 1, size - 1)])):
            yield turn, values


@pytest.mark.parametrize("slice_pairs", [1, 4])
def test_largest_pairs_like_a_direct_solve(monkeypatch, slice_pairs):
    monkeypatch.setattr(eigen, "SLICE_PAIRS", slice_pairs)
    for turn, values in spectra():
        matrix = (turn * values) @ turn.T
        matrix = (matrix + matrix.T) / 2
        direct = np.linalg.eigvalsh(matrix)[::-1]
        got, vectors = largest(matrix, 8)
        floor = len(values) * np.finfo(float).eps * np.abs(matrix).sum(axis=1).max()
        assert len(got) == min(8, int((direct > floor).sum()))
        assert np.abs(got - direct[:len(got)]).max(initial=0) < 1e-13 * direct[0]
        assert np.abs(matrix @ vectors - vectors * got).max(initial=0) < 1e-13 * direct[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max(initial=0) < 1e-13


def test_inertia_counts_eigenvalues():
    for _ in range(30):
        a = RNG.standard_normal((9, 9))
        a, values = a + a.T, np.linalg.eigvalsh(a + a.T)
        for shift in (*RNG.uniform(-6, 6, 5), 0.0):
            assert eigen.count_above(a, shift) == int((values > shift).sum())
    assert eigen.count_above(np.array([[0.0, 1], [1, 0]]), 0) == 1
    assert eigen.count_above(np.zeros((3, 3)), 0) == 0


def test_a_missed_pair_is_noticed():
    matrix = np.diag([4.0, 3, 2, 1])
    with pytest.raises(ArithmeticError):
        eigen.merge_slices(matrix, [(np.array([4.0, 2]), np.eye(4)[:, [0, 2]])], 2)


def embeddings(spark, vectors):
    rows = [(i, v, "x", 1.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n double")


def plain(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)) + 100000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return ((n * x - sums).astype(object) ** 2).sum(axis=1), y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def same_up_to_sign(a, b):
    return np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-9


def test_query_like_a_direct_solve(spark, tmp_path):
    good = [list(map(float, v)) for v in RNG.standard_normal((300, 12)) * np.linspace(1, 3, 12)]
    good += [good[0]] * 40  # equal rows
    bad = [None, [None] * 12, [float("nan")] * 12, good[0][:11] + [float("inf")], good[0][:11] + [None], []]
    embeddings(spark, good + bad).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening(spark, str(tmp_path)).toPandas()
    deviation, whitened, explained = plain(good)
    assert len(got) == 8 * len(good) and set(got.n) == {len(good)} and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    assert list(wide.index) == list(range(len(good))) and list(wide.columns) == list(range(1, 9))
    assert same_up_to_sign(wide.to_numpy(), whitened)
    first = got[got.component == 1].sort_values("vec_id")
    assert list(first.deviation) == [int(d) for d in deviation]
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)


def test_widths_apart_and_no_variance(spark):
    three = [list(map(float, v)) for v in RNG.standard_normal((20, 3))]
    two = [[1.0, 2.0]] * 5
    out = whiten(embeddings(spark, three + two + [[5.0]]), F.col("embedding"), {"whitened": F.col("vec_id")}).collect()
    assert sorted(r["row"]["whitened"] for r in out) == list(range(20)) and {r["n"] for r in out} == {20}
    assert {len(r["whitened"]) for r in out} == {3}
    for none in ([], [None], two, [[1.0, 2.0]]):
        assert whiten(embeddings(spark, none), F.col("embedding"), {"vec_id": F.col("vec_id")}).count() == 0


def test_large_entries(spark):
    wild = [[1e9, 1.0], [-1e9, 2.0], [3e9, 5.0], [1e38, 0.0]]  # the last has no whole number of 62 bits
    out = whiten(embeddings(spark, wild), F.col("embedding"), {"vec_id": F.col("vec_id")}).collect()
    deviation, whitened, _ = plain(wild[:3])
    assert [r["row"]["vec_id"] for r in sorted(out, key=lambda r: r["row"]["vec_id"])] == [0, 1, 2]
    assert {r["row"]["vec_id"]: r["deviation"] for r in out} == {i: int(d) if d < 2**63 else None for i, d in enumerate(deviation)}
