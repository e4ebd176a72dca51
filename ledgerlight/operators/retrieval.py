"""Vector search over chunks and what follows it: threshold, de-duplication, re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import text as tx

TOP_K = 20
RERANK_TOP_K = 10
MIN_SCORE = 0.3
DEDUP_THRESHOLD = 0.9
SNIPPET_CHARS = 500
UNKNOWN_TITLE = "Unknown"

# A query block up to this size is shipped to every task; beyond it both sides are split.
BROADCAST_BYTES = 64 << 20
BLOCK_QUERIES = 1024
BLOCK_CHUNKS = 20_000
# Scores are rounded before ranking, so equal vectors tie and the id decides.
SCORE_DIGITS = 12


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


class _Best:
    """The k best scores seen so far for each query of a block."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = np.full((n_queries, k), -np.inf)

    def candidates(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (query, chunk) that may belong to a top k; ties at the edge are kept."""
        pool = np.concatenate([self.scores, scores], axis=1)
        self.scores = np.partition(pool, pool.shape[1] - self.k, axis=1)[:, -self.k:]
        edge = self.scores.min(axis=1, keepdims=True)
        return np.nonzero(scores >= edge)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def _search_small(queries: list, chunks: DataFrame, k: int, chunk_id: str, vector: str, schema: T.StructType) -> DataFrame:
    sc = chunks.sparkSession.sparkContext
    shared = sc.broadcast(([r[0] for r in queries], _unit(np.array([r[1] for r in queries], dtype=np.float64))))
    id_types = (_arrow_type(schema[0].dataType), _arrow_type(schema[1].dataType))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        starts = range(0, len(ids), BLOCK_QUERIES)
        best = [_Best(min(BLOCK_QUERIES, len(ids) - s), k) for s in starts]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = _unit(_vectors(batch.column(1)))
            for s, keep in zip(starts, best):
                scores = np.round(matrix[s:s + BLOCK_QUERIES] @ unit.T, SCORE_DIGITS)
                q, c = keep.candidates(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[s + i] for i in q], type=id_types[0]),
                     batch.column(0).take(pa.array(c)).cast(id_types[1]),
                     pa.array(scores[q, c])],
                    names=[f.name for f in schema])

    return chunks.select(chunk_id, vector).mapInArrow(scan, schema)


def _search_blocks(queries: DataFrame, chunks: DataFrame, n_queries: int, k: int, query_id: str, query_vector: str,
                   chunk_id: str, vector: str, schema: T.StructType) -> DataFrame:
    """Both sides cut into hash blocks; each task scores one block of each."""
    q_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    c_blocks = max(1, -(-chunks.count() // BLOCK_CHUNKS))

    def block(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"),
                          block(query_id, q_blocks).alias("qb")).withColumn("cb", every(c_blocks))
    right = chunks.select(F.col(chunk_id).alias("cid"), F.col(vector).alias("cv"),
                          block(chunk_id, c_blocks).alias("cb")).withColumn("qb", every(q_blocks))
    names = [f.name for f in schema]

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({n: [] for n in names})
        scores = np.round(_unit(np.stack(q["qv"].to_numpy()).astype(float))
                          @ _unit(np.stack(c["cv"].to_numpy()).astype(float)).T, SCORE_DIGITS)
        i, j = _Best(len(q), k).candidates(scores)
        return pd.DataFrame({names[0]: q["qid"].to_numpy()[i], names[1]: c["cid"].to_numpy()[j], names[2]: scores[i, j]})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(score, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def knn(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, query_id: str = "query_id",
        query_vector: str = "query_vector", chunk_id: str = "chunk_id", vector: str = "embedding",
        where: Column | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact cosine top-k per query: (query_id, chunk_id, score, rank), ties by chunk id.

    Each task keeps only the best k per query of the chunks it scans, so what is shuffled is
    k rows per query and task and never the full product. Queries are shipped to the tasks
    only when they are proven to fit ``broadcast_bytes``; otherwise both sides are split.
    ``where`` narrows the chunks before the search and reaches their scan.
    """
    if where is not None:
        chunks = chunks.where(where)
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(chunk_id, chunks.schema[chunk_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    usable = queries.where(F.size(query_vector) > 0)
    chunks = chunks.where(F.size(vector) > 0)
    width, widest = usable.agg(F.min(F.size(query_vector)), F.max(F.size(query_vector))).first()
    if width is None:
        found = queries.sparkSession.createDataFrame([], schema)
    elif width != widest:
        raise ValueError(f"query vectors of widths {width} to {widest}")
    else:
        # Vectors of another width come from another model; a score against them means nothing.
        other = F.raise_error(F.concat(F.lit(f"vector of a width other than {width}: "), F.size(vector).cast("string")))
        kind = chunks.schema[vector].dataType
        chunks = chunks.withColumn(vector, F.when(F.size(vector) == width, F.col(vector)).otherwise(other.cast(kind)))
        fits = broadcast_bytes // (8 * width)
        head = usable.select(query_id, query_vector).limit(fits + 1).collect()
        if len(head) <= fits:
            found = _search_small(head, chunks, k, chunk_id, vector, schema)
        else:
            found = _search_blocks(usable, chunks, usable.count(), k, query_id, query_vector, chunk_id, vector, schema)
    return top_per_query(found, k, query_id, [F.desc("score"), F.asc(chunk_id)])


def top_per_query(hits: DataFrame, k: int | None, query_id: str, order: list[Column]) -> DataFrame:
    """Adds ``rank`` and keeps the first k; Spark cuts each task's share before the shuffle."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def metadata_filter(filters: Mapping[str, object], allowed: Mapping[str, list], columns: Mapping[str, Column]) -> Column | None:
    """The predicate for a request's metadata filters, or None when nothing applies.

    Keys outside the allow-list are ignored; list values are cut to the allowed ones, and a key
    with none left is ignored too.
    """
    predicate = None
    for key, value in filters.items():
        if key not in allowed or key not in columns:
            continue
        if isinstance(value, (list, tuple)):
            valid = [v for v in value if v in allowed[key]]
            if not valid:
                continue
            part = columns[key] == F.lit(valid[0]) if len(valid) == 1 else columns[key].isin(valid)
        elif value in allowed[key]:
            part = columns[key] == F.lit(value)
        else:
            continue
        predicate = part if predicate is None else predicate & part
    return predicate


def to_hits(found: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    return (found.withColumn("title", F.coalesce(F.col(title), F.lit(UNKNOWN_TITLE)))
            .withColumn("chunk_content", tx.snippet(content, SNIPPET_CHARS)))


def min_score(hits: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    return hits.where(F.col("score") >= threshold) if threshold > 0 else hits


def dedup_hits(hits: DataFrame, threshold: float = DEDUP_THRESHOLD, query_id: str = "query_id",
               content: str = "chunk_content") -> DataFrame:
    """Walks each query's hits in rank order and drops near copies of a hit already kept.

    What is gathered per query is its hit list, which the search has cut to k.
    """
    others = [c for c in hits.columns if c != query_id]
    words = tx.word_set(content)
    gathered = hits.withColumn("_words", words).groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in others if c != "rank"], "_words")),
                     lambda a, b: a["rank"] - b["rank"]).alias("_hits"))
    first = F.slice("_hits", 1, 1)

    def walk(kept: Column, hit: Column) -> Column:
        copy = F.exists(kept, lambda seen: tx.jaccard(seen["_words"], hit["_words"]) >= threshold)
        return F.when(copy, kept).otherwise(F.concat(kept, F.array(hit)))

    rest = F.slice("_hits", F.lit(2), F.greatest(F.size("_hits") - 1, F.lit(0)))
    kept = gathered.select(query_id, F.explode(F.aggregate(rest, first, walk)).alias("_h"))
    return kept.select(query_id, *[F.col(f"_h.{c}").alias(c) for c in others])


def overlap_score(question: str = "question", content: str = "chunk_content") -> Column:
    """Share of the question's words found in the chunk; the scorer used when none is given."""
    q, c = tx.word_set(question), tx.word_set(content)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, scorer: Column | None, k: int = RERANK_TOP_K, query_id: str = "query_id") -> DataFrame:
    """Replaces the score by the scorer's, sorts and cuts; without a scorer only cuts.

    ``scorer`` is any column, a pandas UDF around a model included.
    """
    if scorer is None:
        return hits.where(F.col("rank") <= k)
    scored = hits.withColumn("score", scorer).withColumnRenamed("rank", "_before")
    return top_per_query(scored, k, query_id, [F.desc("score"), F.asc("_before")]).drop("_before")


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = TOP_K
    min_score: float = MIN_SCORE
    dedup: bool = True
    dedup_threshold: float = DEDUP_THRESHOLD
    rerank: bool = False
    rerank_top_k: int = RERANK_TOP_K


def retrieve(queries: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(),
             where: Column | None = None, scorer: Callable[[], Column] = overlap_score) -> DataFrame:
    """Search, snippet, threshold, de-duplication, optional re-ranking and cut, for all queries.

    ``queries`` has query_id, question and query_vector; ``chunks`` has chunk_id, document_id,
    title, content, embedding and whatever else hits are to carry, metadata for one.
    """
    found = knn(queries, chunks, config.top_k, where=where)
    texts = chunks.drop("embedding")
    hits = min_score(to_hits(found.join(texts, "chunk_id")).drop("content"), config.min_score)
    if config.dedup:
        hits = dedup_hits(hits, config.dedup_threshold)
    if config.rerank:
        hits = hits.join(queries.select("query_id", "question"), "query_id")
        return rerank(hits, scorer(), config.rerank_top_k).drop("question")
    return (hits.withColumnRenamed("rank", "_before")
            .transform(lambda h: top_per_query(h, config.rerank_top_k, "query_id", [F.asc("_before")]))
            .drop("_before"))


def retrieval_stats(hits: DataFrame, dimension: int, reranked: bool = False, filter_text: str | None = None,
                    query_id: str = "query_id") -> DataFrame:
    """Vector width, hit count, five best scores, and what was applied, per query."""
    return hits.groupBy(query_id).agg(
        F.lit(dimension).alias("query_embedding_dim"),
        F.count(F.lit(1)).alias("retrieved_count"),
        F.lit(reranked).alias("reranked"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "score")))),
                    lambda s: s["score"]).alias("top_scores"),
        F.lit(filter_text).alias("filter_applied"))
