"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed buckets: one of all documents, one of the documents that labels call good. The log
weight of a document sums the log ratios of its distinct n-grams, Gumbel noise is added, and the top k keys stay.

Two refinements keep the weight from following length. Both models count documents, not occurrences. And a bucket counts
only as far as its ratio is below one beyond chance (``z`` standard errors of its counts, after smoothing): otherwise a
long ordinary text, each of whose words is a little likelier in good text, outweighs any number of bad ones.

Empty cases: a null or empty text has no n-grams and log weight 0; without good labels all weights are 0; a document
labelled more than once is good only if every label says so. Null label values count as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.batches import Texts, binary_text, distinct, gram_hashes, mix, slices, within, word_hashes
from ledgerlight.session import cut_lineage

#: Of each of two tables, 2 ** 22 at most. An n-gram has the milder ratio of its two buckets, so that the odd ordinary
#: word that meets a bad one in one table does not count.
BUCKETS = 1 << 20
#: Kinds of n-grams: words without case and punctuation, and words as they stand, alone, in
#: pairs and as runs of one word. A run counts under each of these lengths that it has, so that the long runs of junk
#: are weighed apart from a word that good text has three times.
GRAMS = (("plain", 1), ("space", 1), ("space", 2), ("space", 3), ("space", 5), ("space", 10), ("space", 20))
#: Good documents the target model is fitted on, the first by a hash of their id.
TARGET_SAMPLE = 20_000
SMOOTHING = 0.5
SURE = 2.0
#: Ratios nearer to one than this count as one.
STRONG = -0.5
#: Log weight below which a document is taken as unlike the target; sets k where none is given.
CUT = -0.5
#: Noise against weight: a key is log weight / TEMPERATURE + Gumbel noise.
TEMPERATURE = 0.02
_CHUNK = 4096


def distinct_buckets(texts: Texts, buckets: int, grams: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, ...]:
    """Text of each of its distinct n-grams, and the n-gram's buckets in the two tables, which stand end to end."""
    keys = []
    for kind in dict.fromkeys(kind for kind, _ in grams):
        found, hashes = word_hashes(texts, kind, lower=kind == "plain")
        equal = np.concatenate(([0], np.cumsum(hashes[1:] == hashes[:-1])))  # words like the one before, up to each
        for n in (n for own, n in grams if own == kind):
            where, owner = within(found.before, n)
            if n > 2:  # one word over and over is the same thing, whatever the word; other long n-grams are too rare
                owner = owner[equal[where + n - 1] - equal[where] == n - 1]
                hashed = np.repeat(mix(np.array([n], dtype=np.uint64)), len(owner))
            else:
                hashed = mix(gram_hashes(hashes, n)[where] + np.uint64(kind == "plain"))
            keys.append((owner.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20)))
    keys = distinct(np.concatenate(keys))
    first, second = keys & np.uint64((1 << 22) - 1), (keys >> np.uint64(22)) & np.uint64((1 << 22) - 1)
    return ((keys >> np.uint64(44)).astype(np.int64), (first % np.uint64(buckets)).astype(np.int64),
            (second % np.uint64(buckets) + np.uint64(buckets)).astype(np.int64))


def good_labels(labels: DataFrame, limit: int = TARGET_SAMPLE) -> DataFrame:
    """Ids of at most ``limit`` good documents."""
    per_doc = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = per_doc.filter((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")


def count_models(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                 grams: tuple[tuple[str, int], ...] = GRAMS) -> tuple[np.ndarray, int, int]:
    """Documents with each bucket, of all and of the good ones, and how many documents there are of either.

    Counts come together as chunks of buckets, summed in Spark; only sums come to the driver.
    """
    good = F.broadcast(good_labels(labels).withColumn("good", F.lit(True)))  # at most TARGET_SAMPLE ids
    rows = docs.select("doc_id", "text").join(good, "doc_id", "left").select(
        F.coalesce("good", F.lit(False)).alias("good"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 2 * buckets), dtype=np.int64)
        docs_in = np.zeros(2, dtype=np.int64)
        for texts in slices(batches):
            owner, *both = distinct_buckets(texts, buckets, grams)
            target = texts.rows.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for bucket in both:
                np.add.at(totals[0], bucket, 1)
                np.add.at(totals[1], bucket[target[owner]], 1)
            docs_in += (len(texts), int(target.sum()))
        if not docs_in[0]:
            return
        pack = zstandard.ZstdCompressor(level=1)
        chunks = range(0, 2 * buckets, _CHUNK)
        bodies = [pack.compress(np.ascontiguousarray(totals[:, c:c + _CHUNK]).tobytes()) for c in chunks]
        yield pa.record_batch([pa.array(np.arange(len(bodies))), pa.array(bodies, pa.binary()),
                               pa.array(np.full(len(bodies), docs_in[0])), pa.array(np.full(len(bodies), docs_in[1]))],
                              names=["chunk", "body", "docs", "targets"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(unpack.decompress(b), dtype=np.int64) for b in group["body"])
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "body": [total.tobytes()],
                             "docs": [group["docs"].sum()], "targets": [group["targets"].sum()]})

    schema = "chunk long, body binary, docs long, targets long"
    # A salt sums what many tasks send in two steps; what comes back has the fixed size of the model.
    parts = binary_text(rows).mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 16)
    first = parts.groupBy("chunk", "salt").applyInPandas(
        lambda group: _packed(add(group)), schema)
    chunks = first.groupBy("chunk").applyInPandas(add, schema).collect()
    counts = np.zeros((2, 2 * buckets))
    for row in chunks:
        at = row["chunk"] * _CHUNK
        counts[:, at:at + _CHUNK] = np.frombuffer(row["body"], dtype=np.int64).reshape(2, -1)
    return counts, *((chunks[0]["docs"], chunks[0]["targets"]) if chunks else (0, 0))


def log_ratios(counts: np.ndarray, raw_docs: int, target_docs: int) -> np.ndarray:
    """Log ratio per bucket, 0 or less."""
    if not target_docs:
        return np.zeros(counts.shape[1], dtype=np.float32)
    expected = counts[0] * (target_docs / raw_docs) + SMOOTHING
    seen = counts[1] + SMOOTHING
    ratio = np.log(seen / expected) + SURE * np.sqrt(1 / seen + 1 / expected)
    return np.where(ratio < STRONG, ratio, 0).astype(np.float32)


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(body=[zstandard.ZstdCompressor(level=1).compress(b) for b in frame["body"]])


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise that depends on the key and the seed alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def weigh(docs: DataFrame, ratios: np.ndarray, grams: tuple[tuple[str, int], ...] = GRAMS) -> DataFrame:
    """``doc_id``, ``log_weight`` and ``finger``, a hash of the text."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)  # fixed size
    rows = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("finger"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            owner, first, second = distinct_buckets(texts, len(model.value) // 2, grams)
            sums = np.bincount(owner, weights=np.maximum(model.value[first], model.value[second]), minlength=len(texts))
            sums = sums.astype(np.float64)  # numpy counts in whole numbers where there is nothing to count
            yield pa.record_batch([texts.rows.column(0), texts.rows.column(2), pa.array(sums)],
                                  names=["doc_id", "finger", "log_weight"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("finger", T.LongType()),
                           T.StructField("log_weight", T.DoubleType())])
    return binary_text(rows).mapInArrow(score, schema)


def kth_largest(rows: DataFrame, column: str, k: int, gather: int = 10_000, bins: int = 1024) -> float:
    """The k-th largest value, exactly: bins are narrowed around it until few values are left to sort."""
    if k <= 0:
        return float("inf")
    low, high, above = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= above:
        return float("-inf") if low is None else low
    above, inside = 0, rows
    while True:
        if low == high:
            return high
        width = (high - low) / bins
        if width == 0 or low + width == low:
            return sorted((r[0] for r in inside.select(column).distinct().collect()), reverse=True)[0]
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"),
                                                          F.max(column).alias("high")).collect(), reverse=True)
        for row in found:
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["low"], row["high"]
        inside = inside.filter(F.col(column).between(low, high))
        if row["n"] <= gather:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29) -> DataFrame:
    """Per document ``doc_id``, ``finger``, ``log_weight``, ``key`` and ``kept``; the ``k`` largest keys are kept.

    Without ``k`` as many stay as have a log weight of ``CUT`` or more. Rows that share the last key all stay.
    """
    weights = cut_lineage(weigh(docs, log_ratios(*count_models(docs, labels))).withColumn(
        "key", F.col("log_weight") / TEMPERATURE + gumbel(F.struct("doc_id", "finger"), seed)))
    if k is None:
        k = weights.filter(F.col("log_weight") >= CUT).count()
    return weights.withColumn("kept", F.col("key") >= kth_largest(weights, "key", k))


def keep_like_target(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29) -> DataFrame:
    """The documents that resampling keeps, all columns as they were."""
    kept = resample(docs, labels, k, seed).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("finger").alias("_finger")).distinct()
    finger = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (finger == kept["_finger"]), "left_semi")
