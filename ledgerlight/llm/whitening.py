"""Whitened components of vectors: centred, turned into principal axes, scaled to variance one.

Tasks add up sums and then products of centred entries in blocks; a row per dimension leaves each task, so what is
shuffled and what reaches the driver depends on the width of the vectors and not on their number. The covariance, of
width squared, is cut into slices of its spectrum on the driver; the slices are solved side by side in tasks
(:mod:`eigen`). Entries are whole numbers, so sums are exact and do not depend on the order of rows.

Defined for awkward rows: a null vector, one with a null or non-finite entry, or with one whose whole number would not
fit 62 bits, is dropped; vectors of different widths are fitted apart, each width as a table of its own; directions
without variance are no components, so equal vectors, a single one or an empty table give none; equal rows count as
often as they stand there; components of equal eigenvalues are some right-angled choice of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.eigen import Slice, merge_slices, slices_of_largest, solve_slice
from ledgerlight.session import cut_lineage

STEP = 1024
SHIFT = 100_000
BLOCK_ROWS = 4096  # vectors multiplied at once in a task
FITS = 2.0**62


class Basis(NamedTuple):
    """``n`` vectors with exact ``sums``; falling ``values`` with unit ``vectors`` as columns; ``trace`` of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The whole number nearest to the mean, by dimension; the mean is ``drift / n`` away from it."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def drift(self) -> list[int]:
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]


def whole_numbers(rows: DataFrame, vector: Column, keep: Mapping[str, Column]) -> DataFrame:
    """``row``, a struct of ``keep``, and ``x``, the usable vectors as whole numbers; the others are dropped."""
    scaled = F.transform(vector, lambda c: c.cast("double") * STEP)
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FITS))
    return (rows.select(F.struct(*[c.alias(name) for name, c in keep.items()]).alias("row"), scaled.alias("v"))
            .filter(F.col("v").isNotNull() & usable)
            .select("row", F.transform("v", lambda c: F.floor(c).cast("long") + SHIFT).alias("x")))


def matrices(batches: Iterator[pa.RecordBatch], name: str, width: int, rows: int = BLOCK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size, each with its vectors as a matrix."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            yield part, part.column(part.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def column_sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sums of ``x`` by dimension. Halves of a number are added apart, so no sum of a block overflows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * width, [0] * width
        for _, x in matrices(batches, "x", width):
            high = [a + int(b) for a, b in zip(high, (x >> 31).sum(axis=0))]
            low = [a + int(b) for a, b in zip(low, (x & (2**31 - 1)).sum(axis=0))]
        yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                              names=["at", "high", "low"])

    total = rows.select("x").mapInArrow(work, "at int, high long, low long").groupBy("at").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    sums = [0] * width
    for r in total.collect():  # a row per dimension
        sums[r["at"]] = int(r["high"]) * 2**31 + int(r["low"])
    return sums


def product_sums(rows: DataFrame, name: str, width: int, centre: np.ndarray) -> np.ndarray:
    """The matrix of sums of products of all pairs of dimensions, ``centre`` taken off first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in matrices(batches, name, width):
            y = (x - centre).astype(np.float64)
            total += y.T @ y
        yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                              names=["at", "row"])

    each = rows.select(name).mapInArrow(work, "at int, row array<double>").select("at", F.posexplode("row").alias("other", "v"))
    out = np.zeros((width, width))
    for r in each.groupBy("at", "other").agg(F.sum("v").alias("v")).collect():  # width squared
        out[r["at"], r["other"]] = r["v"]
    return out


def solve_slices(spark: SparkSession, matrix: np.ndarray, slices: list[Slice]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Eigenpairs of every slice, one task each; a task holds the matrix."""
    if not slices:
        return []

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, low, high, count in frame.itertuples(index=False):
                values, vectors = solve_slice(matrix, Slice(float(low), float(high), int(count)))
                yield pd.DataFrame({"at": at, "value": values, "vector": list(vectors.T)})

    todo = spark.createDataFrame([(i, float(s.low), float(s.high), int(s.count)) for i, s in enumerate(slices)], "at int, low double, high double, count int")
    solved = todo.repartitionByRange(len(slices), "at").mapInPandas(work, "at int, value double, vector array<double>").collect()
    pairs = [sorted((r for r in solved if r["at"] == i), key=lambda r: r["value"]) for i in range(len(slices))]
    return [(np.array([r["value"] for r in p]), np.array([r["vector"] for r in p]).T) for p in pairs]


def fit(rows: DataFrame, n: int, width: int, components: int) -> Basis:
    """The largest ``components`` of the ``n`` vectors ``x``, all of one width."""
    sums = column_sums(rows, width)
    plain = Basis(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    drift = np.array([float(d) for d in plain.drift]) / n
    covariance = product_sums(rows, "x", width, plain.centre) / n - np.outer(drift, drift)
    covariance = (covariance + covariance.T) / 2
    pairs = solve_slices(rows.sparkSession, covariance, slices_of_largest(covariance, components))
    values, vectors = merge_slices(covariance, pairs, components)
    return Basis(n, sums, values, vectors, float(np.trace(covariance)))


def project(rows: DataFrame, basis: Basis) -> DataFrame:
    """``row``, ``deviation`` and ``whitened``, an array by component.

    ``deviation`` is the sum over dimensions of (n * x - sum) squared, exact; null where it does not fit a long.
    """
    n, centre, drift, width = basis.n, basis.centre, basis.drift, len(basis.sums)
    axes, mean = basis.vectors / np.sqrt(basis.values), np.array([float(d) for d in drift]) / n

    def exact(x: np.ndarray) -> list[int | None]:
        y = x - centre
        largest = float(np.abs(y).max(initial=0)) * n + n
        if largest * largest * width < 2.0**62:
            moved = y * n - np.array(drift, dtype=np.int64)
            return (moved * moved).sum(axis=1).tolist()
        found = [sum((n * int(v) - d) ** 2 for v, d in zip(one, drift)) for one in y]
        return [v if v < 2**63 else None for v in found]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, "x", width):
            turned = ((x - centre).astype(np.float64) - mean) @ axes
            yield pa.record_batch([part.column(part.schema.get_field_index("row")), pa.array(exact(x), pa.int64()),
                                   pa.array(list(turned), pa.list_(pa.float64()))], names=["row", "deviation", "whitened"])

    schema = rows.select("row", F.lit(None).cast("long").alias("deviation"), F.expr("cast(array() as array<double>)").alias("whitened")).schema
    return rows.mapInArrow(work, schema)


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """Largest entry by which the covariance of ``whitened`` is off the identity."""
    middle = np.array(rows.agg(*[F.avg(F.col("whitened")[i]) for i in range(components)]).first(), dtype=np.float64)
    return float(np.abs(product_sums(rows, "whitened", components, middle) / n - np.eye(components)).max())


def whiten(rows: DataFrame, vector: Column, keep: Mapping[str, Column], components: int = 8) -> DataFrame:
    """``row``, ``n``, ``deviation``, ``whitened`` and ``explained`` (arrays by component) and ``identity_error``."""
    numbers = whole_numbers(rows, vector, keep)
    widths = numbers.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).filter("width > 0").collect()
    empty = numbers.filter("false").select("row", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                                           F.expr("cast(array() as array<double>)").alias("whitened"),
                                           F.expr("cast(array() as array<double>)").alias("explained"),
                                           F.lit(0.0).alias("identity_error"))
    out = None
    for width, n in sorted((r["width"], r["n"]) for r in widths):
        mine = numbers.filter(F.size("x") == width)
        basis = fit(mine, n, width, components)
        if not len(basis.values):
            continue
        turned = cut_lineage(project(mine, basis))
        share = F.array(*[F.lit(float(v / basis.trace)) for v in basis.values])
        fitted = turned.select("row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"),
                               F.lit(identity_error(turned, n, len(basis.values))).alias("identity_error"))
        out = fitted if out is None else out.unionAll(fitted)
    return empty if out is None else out
