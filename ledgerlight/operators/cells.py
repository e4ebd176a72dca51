"""A table of vectors cut into cells, and exact cosine search that reads only cells that can hold a hit.

A cell is the vectors nearest to one centre (k-means by angle). Inside a cell they lie in order of their angle to the
centre, cut into blocks, so a block is a ring around the centre: its vectors have an angle between ``low`` and ``high``.
By the triangle inequality on angles a vector of the ring is at least ``low - a`` and ``a - high`` away from a query that
is ``a`` from the centre. Queries visit cells in order of that bound, a few at first; the k-th best hit so far then rules
out every block whose bound is worse. What is left is read, so the result is the same as comparing all.

The index is Parquet folders: ``vectors`` by cell, ``blocks``, ``centres``, and ``empty`` for the schema. A block has a bounded number of rows
however many vectors share a cell or are equal; queries meet a block in slices of a bounded number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.retrieval import BLOCK_QUERIES, SCORE_DIGITS, TOP_K, _arrow_type, _Best, _unit, _vectors, top_per_query
from ledgerlight.session import cut_lineage

MAX_CELLS = 4096  # centres are held by the driver and by every task
FIT_ROWS = 200_000  # vectors the centres are fitted on; every vector is indexed
FIT_ROUNDS = 8
BLOCK_ROWS = 4096
NEXT_CELLS = 4  # cells a query visits in the second round, the rest comes in the third
MARGIN = 1e-5  # radians; covers the rounding of scores, whose angle is uncertain by 1.5e-6 near a score of one
NO_LENGTH = -1  # cell of vectors without a length, whose score is zero to any query


class CellIndex(NamedTuple):
    spark: SparkSession
    path: str
    chunk_id: str
    vector: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.table("empty").schema).parquet(f"{self.path}/vectors")


class CellSearch(NamedTuple):
    """``hits`` as of :func:`ledgerlight.operators.retrieval.knn`; ``visits``, the blocks read: query, cell, block, rows."""

    hits: DataFrame
    visits: DataFrame


def _width(df: DataFrame, vector: str) -> int | None:
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of widths {low} to {high}")
    return low


def _fit_centres(usable: DataFrame, vector: str, n: int, cells: int, seed: int) -> np.ndarray:
    sample = usable if n <= FIT_ROWS else usable.sample(FIT_ROWS / n, seed)
    points = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=FIT_ROUNDS, seed=seed).fit(points)
    return _unit(np.array(model.clusterCenters(), dtype=np.float64))


def build_cells(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", vector: str = "embedding",
                cells: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 11) -> CellIndex:
    """Writes the index of ``chunks`` under ``path``; all their columns stay with the vectors.

    ``cells`` is the square root of the number of vectors unless given. Rows without a vector are left out.
    """
    spark = chunks.sparkSession
    index = CellIndex(spark, path, chunk_id, vector)
    chunks = chunks.where(F.size(vector) > 0)
    width = _width(chunks, vector)
    length = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n = chunks.where(length > 0).count()
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    centres = _fit_centres(chunks.where(length > 0), vector, n, cells, seed) if n else np.zeros((0, width or 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column(batch.schema.get_field_index(vector))))
            near = unit @ centres.T if len(centres) else np.zeros((len(unit), 1))
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(unit)), cell], -1, 1))
            cell[~unit.any(axis=1)] = NO_LENGTH
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)],
                                             names=[*batch.schema.names, "cell", "angle"])

    schema = T.StructType([*chunks.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    ranged = (chunks.mapInArrow(place, schema).repartitionByRange("cell", "angle", chunk_id)
              .sortWithinPartitions("cell", "angle", chunk_id))
    # Rows are numbered in order within a partition, so a block is a run of them, cut where the cell ends.
    blocked = ranged.withColumn("block", F.expr(f"monotonically_increasing_id() div {block_rows}"))
    blocked.write.partitionBy("cell").parquet(f"{path}/vectors")
    blocked.limit(0).write.parquet(f"{path}/empty")
    index.vectors().groupBy("cell", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"),
                                        F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>") \
        .write.parquet(f"{path}/centres")
    return index


def _plan(queries: DataFrame, query_id: str, query_vector: str, centres: np.ndarray, numbers: np.ndarray, low: np.ndarray,
          high: np.ndarray, least: int, first: bool, last: bool) -> DataFrame:
    """``qid``, ``qv``, ``limit``, ``cell`` and ``angle`` of the cells that a query visits in this round.

    Cells come in order of their bound. The first round takes them until they hold ``least`` vectors, the second a few
    more, the last all that the query's ``limit`` leaves.
    """
    kind = queries.schema[query_id].dataType
    id_type = _arrow_type(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column(1)))
            limit = batch.column(2).to_numpy(zero_copy_only=False)
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
            bound = np.maximum(np.maximum(angle - high, low - angle), 0)
            blind = ~unit.any(axis=1)  # a query without a length is as near to everything
            bound[blind] = 0
            order = np.lexsort((angle, bound), axis=1)
            held = np.cumsum(numbers[order], axis=1)
            start = (held < least).sum(axis=1) + 1
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            lowest = np.zeros_like(start) if first else start if not last else start + NEXT_CELLS
            highest = start if first else np.full_like(start, order.shape[1]) if last else start + NEXT_CELLS
            visit = (rank >= lowest[:, None]) & (rank < highest[:, None]) & (bound <= limit[:, None] + MARGIN)
            q, c = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(q)).cast(id_type), batch.column(1).take(pa.array(q)), pa.array(limit[q]),
                 pa.array(c.astype(np.int32)), pa.array(np.where(blind[q], np.nan, angle[q, c]))],
                names=["qid", "qv", "limit", "cell", "angle"])

    schema = T.StructType([T.StructField("qid", kind), T.StructField("qv", queries.schema[query_vector].dataType),
                           T.StructField("limit", T.DoubleType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])
    return queries.select(query_id, query_vector, "limit").mapInArrow(work, schema)


def search_cells(queries: DataFrame, index: CellIndex, k: int = TOP_K, query_id: str = "query_id",
                 query_vector: str = "query_vector", where: Column | None = None) -> CellSearch:
    """Exact cosine top-k per query: (query_id, chunk_id, score, rank), ties by chunk id, as :func:`knn` gives.

    ``where`` narrows the vectors by columns kept in the index; blocks are then ruled out by the hits that pass it.
    """
    spark, chunk_id, vector = index.spark, index.chunk_id, index.vector
    blocks, stored = index.table("blocks"), index.vectors()
    centres = np.array([r["centre"] for r in index.table("centres").orderBy("cell").collect()], dtype=np.float64)
    per_cell = {r["cell"]: r for r in blocks.groupBy("cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")).collect()}  # MAX_CELLS at most
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType),
                           T.StructField(chunk_id, stored.schema[chunk_id].dataType), T.StructField("score", T.DoubleType())])
    usable = cut_lineage(queries.where(F.size(query_vector) > 0).select(query_id, query_vector))
    width = _width(usable, query_vector)
    visited = spark.createDataFrame([], T.StructType([schema[0], T.StructField("cell", T.IntegerType()),
                                                      T.StructField("block", T.LongType()), T.StructField("rows", T.LongType())]))
    best = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if width is None or not per_cell:
        return CellSearch(best, visited)
    if len(centres) and width != centres.shape[1]:
        raise ValueError(f"query vectors of width {width}, indexed ones of {centres.shape[1]}")
    slices = max(1, -(-usable.count() // BLOCK_QUERIES))
    centres = centres.reshape(-1, width)
    size = len(centres)
    numbers = np.array([per_cell[c]["rows"] if c in per_cell else 0 for c in range(size)])
    low = np.array([per_cell[c]["low"] if c in per_cell else np.inf for c in range(size)])
    high = np.array([per_cell[c]["high"] if c in per_cell else -np.inf for c in range(size)])
    names = [f.name for f in schema]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names})
        scores = np.round(_unit(np.stack(left["qv"].to_numpy()).astype(float))
                          @ _unit(np.stack(right["cv"].to_numpy()).astype(float)).T, SCORE_DIGITS)
        i, j = _Best(len(left), k).candidates(scores)
        good = scores[i, j] >= left["least"].to_numpy()[i]
        return pd.DataFrame({names[0]: left["qid"].to_numpy()[i[good]], names[1]: right["cid"].to_numpy()[j[good]],
                             names[2]: scores[i[good], j[good]]})

    for step in range(3):
        edge = best.where(F.col("rank") == k).select(query_id, F.col("score").alias("least")) if step else None
        asked = (usable.join(edge, query_id, "left") if step else usable.withColumn("least", F.lit(None).cast("double")))
        asked = asked.withColumn("least", F.coalesce("least", F.lit(-2.0))).withColumn(
            "limit", F.when(F.col("least") < -1, F.lit(math.pi)).otherwise(F.acos(F.least(F.col("least"), F.lit(1.0)))))
        cells = _plan(asked, query_id, query_vector, centres, numbers, low, high, k, step == 0, step == 2)
        away = F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle"), F.lit(0.0))
        ring = F.col("angle").isNull() | F.isnan("angle") | (away <= F.col("limit") + MARGIN)
        visits = cells.join(blocks, "cell").where(ring).select("qid", "qv", "limit", "cell", "block", "rows")
        if step == 2 and NO_LENGTH in per_cell:  # score zero: only for queries whose k-th hit is no better
            rest = blocks.where(F.col("cell") == NO_LENGTH).select("cell", "block", "rows")
            none = asked.where(F.col("least") <= 0).select(F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"), "limit")
            visits = visits.unionAll(none.withColumn("cell", F.lit(NO_LENGTH)).join(rest, "cell")
                                     .select("qid", "qv", "limit", "cell", "block", "rows"))
        visits = cut_lineage(visits.join(asked.select(F.col(query_id).alias("qid"), "least"), "qid")
                             .withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices))))
        wanted = [r[0] for r in visits.select("cell").distinct().collect()]  # MAX_CELLS at most
        visited = visited.unionAll(visits.select("qid", "cell", "block", "rows"))
        if not wanted:
            continue
        rows = stored.where(F.col("cell").isin(wanted))
        rows = (rows if where is None else rows.where(where)).select(
            "cell", "block", F.col(chunk_id).alias("cid"), F.col(vector).alias("cv"))
        key = ["cell", "block", "slice"]
        rows = rows.join(visits.select(*key).distinct().toDF(*key), ["cell", "block"])
        found = visits.select(*key, "qid", "qv", "least").groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(score, schema)
        best = cut_lineage(top_per_query(found.unionAll(best.select(*names)), k, query_id, [F.desc("score"), F.asc(chunk_id)]))
    return CellSearch(best, visited)
