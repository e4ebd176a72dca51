"""Language identification: hashed subword embeddings, averaged over the text, under a linear softmax.

Subwords are runs of two and three bytes of the text with A-Z in lower case and all that is no word as a blank. The
embeddings and the softmax are trained by stochastic gradient descent in numpy on a bounded sample; a temperature and a
rejection bound are then set on a part of the sample held back from training. The average of embeddings times the
softmax weights is an average over subwords of one small table, so whole texts are scored by table look-up.

Empty cases: a null text, or one without a letter, is ``und`` with score 0; without training rows so is every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.batches import PLAIN_WORDS, Texts, binary_text, mix, slices

BUCKETS = 8192
GRAMS = (2, 3)
WIDTH = 16
#: Texts the model is trained and calibrated on, the first by a hash of their id.
TRAIN_DOCS = 2_000
HELD_BACK = 5  # one in so many of them only calibrates
EPOCHS, BATCH, RATE = 12, 32, 0.5
#: Small samples are gone through more often, until so many steps are made.
LEAST_STEPS = 800
#: Share of rightly named calibration texts that the rejection bound may reject.
WRONGLY_REJECTED = 0.01
UNKNOWN = "und"

_BYTES = np.frombuffer(PLAIN_WORDS, dtype=np.uint8)
_LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


class Model(NamedTuple):
    """``table``: a row of class scores per bucket; scores are divided by ``temperature`` before the softmax."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each subword."""
    data = _BYTES[texts.data].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.starts))
    buckets, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        value = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | data[k:len(data) - n + 1 + k]
        inside = owner[:len(value)] == owner[n - 1:]
        buckets.append((mix(value[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:len(value)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def has_letter(texts: Texts) -> np.ndarray:
    found = np.concatenate(([0], np.cumsum(_LETTERS[texts.data])))
    out = found[texts.starts[1:]] > found[texts.starts[:-1]]
    for i in np.flatnonzero(~out & (np.diff(texts.starts) > 0)):
        out[i] = any(c.isalpha() for c in texts.text(i).decode("utf-8", "ignore"))
    return out


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample_vectors(docs: DataFrame, limit: int) -> tuple[np.ndarray, list[str]]:
    """Share of each bucket in the subwords of each sample text, and the texts' languages."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                        & F.col("text").isNotNull()).withColumn("finger", F.xxhash64("text"))
    # Ids are cut to the sample first, so that no task meets more texts than the sample has.
    ids = known.select("doc_id", "finger").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "finger").limit(limit)
    sample = known.join(F.broadcast(ids), ["doc_id", "finger"], "left_semi").dropDuplicates(["doc_id", "finger"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            bucket, owner = subwords(texts)
            keys, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
            at = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
            yield pa.record_batch([
                texts.rows.column(0),
                pa.array([(keys[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                pa.array([n[a:b].astype(np.float32).tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                names=["lang", "buckets", "counts"])

    rows = binary_text(sample.select("lang", "text")).mapInArrow(count, "lang string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["counts"])))  # not as tasks happen to end
    vectors = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, row in enumerate(rows):
        counts = np.frombuffer(row["counts"], dtype=np.float32)
        vectors[i, np.frombuffer(row["buckets"], dtype=np.int32)] = counts / max(counts.sum(), 1)
    return vectors, [r["lang"] for r in rows]


def train(docs: DataFrame, limit: int = TRAIN_DOCS, seed: int = 11) -> Model:
    """Fit on at most ``limit`` rows of ``doc_id``, ``text`` and ``lang`` that are not held out."""
    vectors, names = _sample_vectors(docs, limit)
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    wanted = np.array([languages.index(x) for x in names])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(names))
    back = order[::HELD_BACK] if len(order) >= 10 * HELD_BACK else order[:0]
    learn = np.setdiff1d(order, back)
    # Rare subwords matter as much as common ones: each bucket is scaled by its spread over the sample.
    scale = 1 / (vectors[learn].std(axis=0) + 1e-4)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    parts = -(-len(learn) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // parts))
    steps, step = epochs * parts, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learn), parts):
            x = vectors[part] * scale * (1 / np.sqrt(BUCKETS))
            hidden = x @ embed
            scores = hidden @ weight + bias
            wrong = np.exp(scores - scores.max(axis=1, keepdims=True))
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(part)), wanted[part]] -= 1
            wrong /= len(part)
            rate = RATE * (1 - step / steps)
            into = wrong @ weight.T
            weight -= rate * hidden.T @ wrong
            bias -= rate * wrong.sum(axis=0)
            embed -= rate * x.T @ into
            step += 1
    table = (embed * (scale / np.sqrt(BUCKETS))[:, None]) @ weight
    return _calibrated(Model(languages, table, bias, 1.0, 0.0), vectors[back], wanted[back])


def probabilities(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _calibrated(model: Model, vectors: np.ndarray, wanted: np.ndarray) -> Model:
    """Temperature of least log loss on held-back texts, and the bound below which a name is rejected."""
    if not len(wanted):
        return model
    scores = vectors @ model.table + model.bias
    at = np.arange(len(wanted))
    losses = {t: -np.log(probabilities(scores / t)[at, wanted] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    temperature = float(min(losses, key=losses.get))
    found = probabilities(scores / temperature)
    right = found.argmax(axis=1) == wanted
    bound = float(np.quantile(found.max(axis=1)[right], WRONGLY_REJECTED)) if right.any() else 0.0
    return model._replace(temperature=temperature, reject_below=bound)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``lang_pred``, ``score`` and ``rejected``: the score is too low to rely on the name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    key = docs.schema[doc_id].dataType

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for texts in slices(batches):
            known = has_letter(texts) if own.languages else np.zeros(len(texts), dtype=bool)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if known.any():
                bucket, owner = subwords(texts)
                total = np.bincount(owner, minlength=len(texts))
                mean = np.stack([np.bincount(owner, weights=own.table[:, c][bucket], minlength=len(texts))
                                 for c in range(len(own.languages))], axis=1) / np.maximum(total, 1)[:, None]
                found = probabilities((mean + own.bias) / own.temperature)
                best, score = found.argmax(axis=1), found.max(axis=1)
            names = [own.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, score, 0.0)
            yield pa.record_batch([texts.rows.column(0), pa.array(names, pa.string()), pa.array(score),
                                   pa.array(score < own.reject_below)], names=["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField("doc_id", key), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return binary_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(name, schema)
