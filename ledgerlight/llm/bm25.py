"""Exact top-k search by BM25: an inverted index per shard, searched with dynamic pruning by bounds of terms and blocks.

A shard is a run of documents with its own index. How many documents hold a term is counted over all shards, so every
shard scores by the same statistics and the best k of all shards are the best k.

A task goes through its shards one after another and keeps the best k of each query so far, so a shard only has to name
what beats the k-th of the shards before, and a task gives k rows a query however many shards it has. What some terms can
add to any document is bounded by their largest weights: if that is less than the k-th best score, documents without the
other terms are passed over, and if few are near with them, only those are scored. Otherwise the postings of all rarer
terms are summed. Common terms are kept as columns, in blocks of documents of like length: a block is bounded by its
largest weights and by its longest vector (Cauchy-Schwarz), and only blocks that may reach the k-th best score are
multiplied with the queries at hand. What is left is scored in full. Nothing that could be among the best is passed over.

Queries are packed and sent to the shards in groups of bounded size; each group is one pass over the index.

score = sum over distinct query words of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)),
words in lower case (A-Z) of letters, digits and all that is not ASCII, rounded to 6 places; equal scores rank by id.
Empty cases: a null or empty text has length 0, is found by nothing and finds nothing; a document that shares no word
with a query is not among its results; rows repeated are found as often as they stand there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.batches import binary_text, slices, word_hashes
from ledgerlight.llm.lm_score import answer_lists, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from ledgerlight.session import cut_lineage

K1, B = 1.2, 0.75
SHARD_BYTES = 32 << 20
#: Packed queries in one pass over the index.
GROUP_BYTES = 16 << 20
RANGE_BYTES = 16 << 20
#: Terms in more than one document in so many are kept as columns over all documents of the shard, as far as there is room.
COMMON = 16
COLUMN_BYTES = 64 << 20
BLOCK_DOCS = 64
#: Queries that meet a shard together, and sums held for them.
QUERIES_AT_ONCE = 128
SUMS_AT_ONCE = 1 << 20
POSTING = np.dtype([("doc", np.int32), ("weight", np.float32)])
#: Lists of so many postings are read together.
SHORT_LIST = 64
KEY_BITS = 60


def index_shards(docs: DataFrame, ranges: int, shard_bytes: int) -> DataFrame:
    """One row per shard: ids and lengths of its documents, terms by hash range, and terms and frequencies by document."""
    rows = docs.select("doc_id", "text")

    def shard(held: list, name: str) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        lengths = np.concatenate([h[1] for h in held])
        keys = np.concatenate([h[2] for h in held]) >> np.uint64(64 - KEY_BITS)
        held.clear()
        turn = np.argsort(keys, kind="stable")  # by term, then document
        keys = keys[turn]
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[turn]
        del turn
        term_new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        pair_new = term_new | np.concatenate(([True], owner[1:] != owner[:-1])) if len(keys) else term_new
        terms, at = keys[term_new], np.flatnonzero(pair_new)
        tf = np.diff(at, append=len(keys)).astype(np.int32)
        term, doc = (np.cumsum(term_new, dtype=np.int32) - 1)[at], owner[at]
        del keys, owner, term_new, pair_new, at
        holders = np.bincount(term, minlength=len(terms))
        width = (1 << KEY_BITS) // ranges + 1
        cuts = np.searchsorted(terms, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        lists = [{"part": k, "keys": pack_sorted(terms[a:b]), "times": pack_counts(holders[a:b])}
                 for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        by_doc = np.argsort(doc, kind="stable")
        return pa.record_batch(
            [pa.array([name]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([len(lengths)]),
             pa.array([int(lengths.sum())]), pa.array([pack_counts(lengths)], pa.binary()),
             pa.array([pack_counts(np.bincount(doc, minlength=len(lengths)))], pa.binary()),
             pa.array([pack_counts(term[by_doc])], pa.binary()), pa.array([pack_counts(tf[by_doc])], pa.binary()),
             pa.array([lists], pa.list_(pa.struct([("part", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])))],
            names=["block", "ids", "n_docs", "n_words", "lengths", "sizes", "terms", "tf", "lists"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        for texts in slices(batches):
            found, hashes = word_hashes(texts, "plain")
            held.append((texts.rows.column(0), found.counts, hashes))
            size += len(texts.data) + 16 * len(texts)
            if size >= shard_bytes:
                yield shard(held, f"{TaskContext.get().partitionId()}-{made}")
                size, made = 0, made + 1
        if held:
            yield shard(held, f"{TaskContext.get().partitionId()}-{made}")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return binary_text(rows).mapInArrow(
        work, f"block string, ids array<{kind}>, n_docs long, n_words long, lengths binary, sizes binary, terms binary, "
              "tf binary, lists array<struct<part: bigint, keys: binary, times: binary>>")


class Queries(NamedTuple):
    ids: list
    ends: np.ndarray  # where each query's words end
    keys: np.ndarray
    idf: np.ndarray


class Best:
    """The best k documents of each query among the shards that a task has gone through, by score, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.zeros((queries, k))  # descending; 0 where a place is free
        self.places = np.full((queries, k), -1, dtype=np.int64)
        self.ids = None

    def begin(self, ids: pa.Array) -> int:
        """Adds a shard's ids; its documents are placed behind those of the shards before."""
        first = 0 if self.ids is None else len(self.ids)
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        return first

    def add(self, q: int, places: np.ndarray, scores: np.ndarray) -> None:
        k = self.k
        scores, places = np.concatenate((self.scores[q], scores)), np.concatenate((self.places[q], places))
        order = np.argsort(-scores, kind="stable")
        last = scores[order[k - 1]]
        if len(order) > k and last > 0 and scores[order[k]] == last:  # ids decide among equals
            above, equal = order[scores[order] > last], order[scores[order] == last]
            by_id = pc.array_sort_indices(self.ids.take(pa.array(places[equal])), null_placement="at_end").to_numpy()
            order = np.concatenate((above, equal[by_id]))
        self.scores[q], self.places[q] = scores[order[:k]], places[order[:k]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, place and score, for each document found."""
        found = self.scores > 0
        return np.repeat(np.arange(len(found)), found.sum(axis=1)), self.places[found], self.scores[found]


class Shard:
    """The index of one shard as arrays: postings by term, terms by document, columns of common terms, and bounds.

    Weights are what a term of a query adds to a document's score. Documents stand in order of length, so that a block's
    are alike.
    """

    def __init__(self, row: dict, queries: Queries, mean_length: float):
        keys = np.concatenate([unpack_sorted(x["keys"]) for x in row["lists"]]) if row["lists"] else np.zeros(0, np.uint64)
        self.term = _found(keys, queries.keys)
        known = self.term >= 0
        idf = np.zeros(len(keys))
        idf[self.term[known]] = queries.idf[known]
        sizes, lengths = unpack_counts(row["sizes"]), unpack_counts(row["lengths"])
        self.n = len(sizes)
        self.place = np.argsort(lengths, kind="stable")
        turned = np.empty(self.n, dtype=np.int32)
        turned[self.place] = np.arange(self.n, dtype=np.int32)
        self.by_doc = np.concatenate(([0], np.cumsum(sizes)))
        self.doc_terms = unpack_counts(row["terms"]).astype(np.int32)
        tf = unpack_counts(row["tf"]).astype(np.float64)
        length = np.repeat(lengths.astype(np.int32), sizes)
        self.doc_weights = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))
        del tf, length
        self.doc_weights *= idf[self.doc_terms]
        turn = np.argsort(self.doc_terms, kind="stable")
        docs, weights = np.repeat(turned, sizes)[turn], self.doc_weights[turn]
        del turn
        self.postings = np.empty(len(docs), dtype=POSTING)
        self.postings["doc"], self.postings["weight"] = docs, weights
        counts = np.bincount(self.doc_terms, minlength=len(keys))
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.most = np.maximum.reduceat(weights, self.starts[:-1]) if len(keys) else np.zeros(0)
        blocks = -(-self.n // BLOCK_DOCS)
        common = np.flatnonzero((counts * COMMON > self.n) & (idf > 0))
        room = COLUMN_BYTES // (4 * blocks * BLOCK_DOCS)
        common = np.sort(common[np.argsort(-counts[common], kind="stable")[:room]])
        self.column = np.full(len(keys), -1, dtype=np.int64)
        self.column[common] = np.arange(len(common))
        # By block, then term, then document.
        self.columns = np.zeros((blocks, len(common), BLOCK_DOCS), dtype=np.float32)
        squares = np.zeros(blocks * BLOCK_DOCS)
        for i, t in enumerate(common):
            own = slice(self.starts[t], self.starts[t + 1])
            self.columns[docs[own] // BLOCK_DOCS, i, docs[own] % BLOCK_DOCS] = weights[own]
            squares[docs[own]] += weights[own] ** 2 / idf[t]
        self.idf_common = idf[common].astype(np.float32)
        self.block_most = np.ascontiguousarray(self.columns.max(axis=2).T) if len(common) else np.zeros((0, blocks), np.float32)
        self.block_norm = np.sqrt(squares.reshape(blocks, BLOCK_DOCS).max(axis=1, initial=0.0))
        self.asked = np.zeros(len(keys), dtype=bool)  # terms of the query at hand
        # Weights are in single precision: a sum of so many of them may be off by this part of it.
        self.error = 1e-5 + 1e-7 * len(common)

    def sums(self, terms: np.ndarray) -> np.ndarray:
        """What the postings of the terms add to each document."""
        first, n = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        few, postings = n <= SHORT_LIST, self.postings.view(np.int64)
        short = n[few]
        where = np.arange(short.sum()) + np.repeat(first[few] - (np.cumsum(short) - short), short)
        spans = zip(first[~few].tolist(), (first + n)[~few].tolist())
        own = np.concatenate([postings[where], *(postings[a:b] for a, b in spans)]).view(POSTING)
        return np.bincount(own["doc"], own["weight"], minlength=self.n)

    def score(self, places: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Scores in double precision, terms in order of their hash: the same in any shard."""
        self.asked[terms] = True
        out = np.zeros(len(places))
        for i, (a, b) in enumerate(zip(self.by_doc[places].tolist(), self.by_doc[places + 1].tolist())):
            out[i] = self.doc_weights[a:b][self.asked[self.doc_terms[a:b]]].sum()
        self.asked[terms] = False
        return np.round(out, 6)

    def search(self, first: int, queries: list[np.ndarray], best: Best, offset: int) -> None:
        """Brings the best documents of some queries, given by their terms, up to date with this shard's documents."""
        k, count, blocks = best.k, len(queries), len(self.columns)
        least = best.scores[first:first + count, k - 1]
        reach = least - self.error * (1 + least)
        reach[least == 0] = 0
        sums = np.zeros((count, blocks * BLOCK_DOCS), dtype=np.float32)
        asks = np.zeros((count, len(self.idf_common)), dtype=np.float32)
        open_ = np.ones(count, dtype=bool)

        def keep(i: int, near: np.ndarray) -> None:
            if len(near):
                scores = self.score(self.place[near], queries[i])
                good = (scores > 0) & (scores >= least[i])
                best.add(first + i, offset + self.place[near[good]], scores[good])

        for i, terms in enumerate(queries):
            column = self.column[terms]
            rare, shared = terms[column < 0], column[column >= 0]
            most = self.most[rare]
            turn = np.argsort(-most, kind="stable")
            rare = rare[turn]
            # What terms from each place on can add; those that cannot lift a document by themselves need not be read
            # if few documents are near with the others.
            rest = np.concatenate((np.cumsum(most[turn][::-1])[::-1], [0.0])) + self.most[terms[column >= 0]].sum()
            needed = int(np.argmax(rest < reach[i])) if rest[-1] < reach[i] else len(rare)
            if not len(terms) or rest[0] < reach[i]:
                open_[i] = False
                continue
            own = self.sums(rare[:needed])
            if rest[needed] < reach[i]:
                near = np.flatnonzero(own + rest[needed] >= reach[i])
                if len(near) <= 2 * k:
                    keep(i, near)
                    open_[i] = False
                    continue
                own += self.sums(rare[needed:])
            sums[i, :self.n] = own
            asks[i, shared] = 1
        bound = np.minimum(asks @ self.block_most, np.sqrt(asks @ self.idf_common)[:, None] * self.block_norm)
        bound = bound * (1 + self.error) + sums.reshape(count, blocks, BLOCK_DOCS).max(axis=2)
        alive = (bound >= reach[:, None]) & (bound > 0) & open_[:, None]
        for j, own in enumerate(alive.T):
            span = slice(j * BLOCK_DOCS, (j + 1) * BLOCK_DOCS)
            if own.all():
                sums[:, span] += asks @ self.columns[j]
            else:
                sums[~own, span] = -1
                if own.any():
                    sums[own, span] += asks[own] @ self.columns[j]
        for i in np.flatnonzero(open_):
            near = np.flatnonzero(sums[i] >= reach[i]) if reach[i] > 0 else np.flatnonzero(sums[i] > 0)
            if len(near) > 2 * k:
                values = sums[i, near]
                kth = float(np.partition(values, len(near) - k)[len(near) - k])
                near = near[values >= kth - 2 * self.error * (1 + kth)]
            keep(i, near)


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key among the ascending ones, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _search(row: dict, ids: pa.Array, queries: Queries, mean_length: float, best: Best) -> None:
    offset = best.begin(ids)
    shard = Shard(row, queries, mean_length)
    starts = [0, *queries.ends]
    size = max(1, min(QUERIES_AT_ONCE, SUMS_AT_ONCE // max(shard.n, 1)))
    for first in range(0, len(queries.ids), size):
        last = min(first + size, len(queries.ids))
        terms = [shard.term[a:b] for a, b in zip(starts[first:last], starts[first + 1:last + 1])]
        shard.search(first, [t[t >= 0] for t in terms], best, offset)


def top_documents(docs: DataFrame, asks: Column, k: int = 10, shard_bytes: int = SHARD_BYTES,
                  group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id`` and ``score``: the best ``k`` documents for each whose row ``asks`` holds for."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source = docs.select("doc_id", "text")
    tasks = max(1, -(-size // shard_bytes), spark.sparkContext.defaultParallelism)
    made = cut_lineage(index_shards(source.coalesce(tasks), max(1, -(-size // RANGE_BYTES)), shard_bytes))
    n_docs, n_words = made.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, mean_length = n_docs or 0, (n_words or 0) / max(n_docs or 0, 1)
    lists = made.select("block", F.explode("lists").alias("l")).select("block", "l.*")
    answers = lists.groupBy("part").applyInPandas(answer_lists, "block string, part long, counts binary").groupBy("block").agg(
        F.collect_list(F.struct("part", "counts")).alias("answers"))
    wanted = docs.filter(asks).select("doc_id").distinct().withColumn("asks", F.lit(True))
    picked = made.select("block", F.posexplode("ids").alias("place", "doc_id")).join(wanted, "doc_id").groupBy("block").agg(
        F.collect_list("place").alias("places"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys = np.concatenate([unpack_sorted(x["keys"]) for x in row["lists"]] or [np.zeros(0, np.uint64)])
                found = [unpack_counts(a["counts"]) for a in sorted(row["answers"] or [], key=lambda a: a["part"])]
                holders = np.concatenate(found or [np.zeros(0, np.int64)])
                ends, terms = np.cumsum(unpack_counts(row["sizes"])), unpack_counts(row["terms"])
                ids, packed, counts = [], [], []
                for p in row["places"]:
                    own = np.sort(terms[(ends[p - 1] if p else 0):ends[p]])
                    if len(own):
                        ids.append(row["ids"][p])
                        packed.append(pack_sorted(keys[own]))
                        counts.append(pack_counts(holders[own]))
                yield pa.record_batch([pa.array(ids, batch.column("ids").type.value_type), pa.array(packed, pa.binary()),
                                       pa.array(counts, pa.binary())], names=["query_id", "keys", "holders"])

    schema = f"query_id {kind.simpleString()}, keys binary, holders binary"
    asked = cut_lineage(made.select("block", "ids", "lists", "sizes", "terms").join(picked, "block").join(answers, "block")
                        .mapInArrow(extract, schema).dropDuplicates(["query_id", "keys"]))
    total = asked.agg(F.sum(F.length("keys") + F.length("holders"))).first()[0] or 0
    groups = -(-total // group_bytes)
    out = None
    for g in range(groups):
        rows = asked.filter(F.pmod(F.xxhash64("query_id", "keys"), F.lit(groups)) == g).collect()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        holders = np.concatenate([unpack_counts(r["holders"]) for r in rows] or [np.zeros(0, np.int64)])
        idf = np.log1p((n_docs - holders + 0.5) / (holders + 0.5))
        queries = spark.sparkContext.broadcast(Queries(
            [r["query_id"] for r in rows], np.cumsum([len(x) for x in keys]).tolist(), np.concatenate(keys or [np.zeros(0, np.uint64)]), idf))

        def search(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            best = Best(len(queries.value.ids), k)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.drop_columns(["ids"]).slice(i, 1).to_pylist()[0]
                    _search(row, batch.column("ids").slice(i, 1).flatten(), queries.value, mean_length, best)
            if best.ids is not None:
                ask, place, score = best.rows()
                yield pa.record_batch([pa.array([queries.value.ids[q] for q in ask], best.ids.type), pa.array(ask, pa.int64()),
                                       best.ids.take(pa.array(place, pa.int64())), pa.array(score, pa.float64())],
                                      names=["query_id", "ask", "doc_id", "score"])

        found_schema = T.StructType([T.StructField("query_id", kind), T.StructField("ask", T.LongType()),
                                     T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
        # A task a slot: each gives its best k of all its shards, so that rows follow the queries and not the shards.
        found = made.select("block", "ids", "lists", "lengths", "sizes", "terms", "tf").coalesce(
            spark.sparkContext.defaultParallelism).mapInArrow(search, found_schema)
        found = found.withColumn("ask", F.col("ask") + (g << 40))
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    # A query's rows are the best k of each task's shards.
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score")
