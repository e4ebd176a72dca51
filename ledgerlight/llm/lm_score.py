"""Language-model scores with stupid backoff.

The probability of a word after its context is count(n-gram) / count(context) where the n-gram occurs ``min_count`` times
or more, else ``BACKOFF`` times that after a context one word shorter, down to count(word) / all words. A document's
score is the mean logarithm over its words.

Counting is a join by hash. Documents go together in blocks; each block lists its distinct n-grams once, by hash, with
their number in the block, and keeps the words of its places, by number. The lists meet in partitions of the hash
range, where they make up the count table; each list gets its counts back, and each block sums its documents. No key is
hot, as the commonest word is one entry per block, and neither lists nor tables leave their partitions.

Words are cut at blanks, A-Z in lower case. Empty cases: a null or empty text has no words and a null score; without
documents there are no rows; repeated rows count as often as they stand there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.batches import binary_text, distinct, gram_hashes, slices, word_hashes
from ledgerlight.session import cut_lineage

ORDER = 2
BACKOFF = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 8 << 20
#: Text whose n-grams meet in one partition of the hash range.
RANGE_BYTES = 8 << 20
#: Two n-grams of a corpus share a hash with a chance of 1 in 2 ** SPARE_BITS at most.
SPARE_BITS = 20
LOOKUP = 1 << 17  # keys looked up at once


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte by byte, compressed: high bytes are nearly all zero."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(body: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Whole numbers, mostly small ones, byte by byte and compressed."""
    width = 4 if not len(counts) or (counts.min() >= 0 and counts.max() < 1 << 32) else 8
    raw = counts.astype(np.uint32 if width == 4 else np.uint64).view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_counts(body: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), dtype=np.uint8)
    kind = np.uint32 if body[0] == 4 else np.uint64
    return np.ascontiguousarray(raw.reshape(body[0], -1).T).view(kind).ravel().astype(np.int64)


def gram_keys(words: np.ndarray, counts: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """Keys of the n-grams that lie within documents, for n from 1 up, from the keys of the words."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [words]
    for n in range(2, order + 1):
        own = gram_hashes(words, n) >> np.uint64(64 - bits)
        out.append(own[place[n - 1:] >= n - 1])
    return out


def listed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, how often each stands there, and which of them each key is."""
    turn = np.argsort(keys)
    keys = keys[turn]
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    index = np.empty(len(keys), dtype=np.int32)
    index[turn] = np.cumsum(first, dtype=np.int32) - 1
    return keys[starts], np.diff(starts, append=len(keys)), index


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each stands there. Sorts the array itself: no other of its size is made."""
    keys.sort()
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    return keys[starts], np.diff(starts, append=len(keys))


def looked_up(values: np.ndarray, among: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value beside each key among the distinct ones, which ascend and hold all keys; places are found by parts."""
    out = np.empty(len(keys), dtype=values.dtype)
    for a in range(0, len(keys), LOOKUP):
        out[a:a + LOOKUP] = values[np.searchsorted(among, keys[a:a + LOOKUP])]
    return out


def blocks(docs: DataFrame, order: int, ranges: int, bits: int, block_bytes: int) -> DataFrame:
    """One row per block: its documents, their words, commonest first, and its list of n-grams, cut by hash range."""
    rows = docs.select("doc_id", "text")

    def block(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], name: str) -> pa.RecordBatch:
        ids = pa.concat_arrays([ids for ids, _, _ in held])
        counts = np.concatenate([counts for _, counts, _ in held])
        hashes = np.concatenate([hashes for _, _, hashes in held])
        held.clear()  # a block's arrays are many times its text, so none is kept beyond its use
        words = gram_hashes(hashes, 1) >> np.uint64(64 - bits)
        del hashes
        vocabulary, times, index = listed(words)
        common = np.argsort(-times, kind="stable")
        number = np.empty(len(common), dtype=np.int32)
        number[common] = np.arange(len(common), dtype=np.int32)
        places = pack_counts(number[index])
        del index, number
        every = np.concatenate(gram_keys(words, counts, order, bits))
        del words
        keys, times = tallied(every)
        del every
        width = (1 << bits) // ranges + 1
        cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        lists = [{"part": k, "keys": pack_sorted(keys[a:b]), "times": pack_counts(times[a:b])}
                 for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.record_batch(
            [pa.array([name]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([pack_counts(counts)], pa.binary()),
             pa.array([pack_counts(vocabulary[common].astype(np.int64))], pa.binary()), pa.array([places], pa.binary()),
             pa.array([lists], pa.list_(pa.struct([("part", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])))],
            names=["block", "ids", "words", "vocabulary", "places", "lists"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        for texts in slices(batches):
            found, hashes = word_hashes(texts, "space")
            ids = texts.rows.column(0)
            # A copy: a slice would keep the whole batch, its texts included, until the block is full.
            held.append((ids.take(pa.array(np.arange(len(ids)))), found.counts, hashes))
            size += len(texts.data) + 16 * len(texts)
            if size >= block_bytes:
                yield block(held, f"{TaskContext.get().partitionId()}-{made}")
                held, size, made = [], 0, made + 1
        if held:
            yield block(held, f"{TaskContext.get().partitionId()}-{made}")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return binary_text(rows).mapInArrow(work, f"block string, ids array<{kind}>, words binary, vocabulary binary, places binary, "
                                              "lists array<struct<part: bigint, keys: binary, times: binary>>")


def answer_lists(group: pd.DataFrame) -> pd.DataFrame:
    """The count table of one hash range, and each block's counts from it, in the order of its list."""
    lists = [unpack_sorted(k) for k in group["keys"]]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    keys = np.concatenate(lists)
    del lists
    turn = np.argsort(keys)
    keys = keys[turn]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    del keys
    totals = np.add.reduceat(np.concatenate([unpack_counts(t) for t in group["times"]])[turn], np.flatnonzero(first))
    counts = np.empty(len(turn), dtype=np.int64)
    counts[turn] = totals[np.cumsum(first, dtype=np.int32) - 1]
    del turn, totals
    return pd.DataFrame({"block": group["block"], "part": group["part"], "counts": [pack_counts(c) for c in np.split(counts, cuts)]})


def _log_scores(row: dict, answers: list, total: int, order: int, min_count: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log probability of each document of a block."""
    words = unpack_counts(row["words"])
    counts = [unpack_counts(a["counts"]) for a in sorted(answers, key=lambda a: a["part"])]
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(words) - words, words)
    grams = gram_keys(unpack_counts(row["vocabulary"]).astype(np.uint64)[unpack_counts(row["places"])], words, order, bits)
    among = distinct(np.concatenate(grams))
    by_end = []  # counts of the n-gram that ends at each word
    for n in range(1, order + 1):
        own = np.zeros(len(owner), dtype=np.int64)
        own[place >= n - 1] = looked_up(counts, among, grams[n - 1])
        grams[n - 1] = None
        by_end.append(own)
    del among, counts
    out = np.log(by_end[0] / total)
    known = np.zeros(len(owner), dtype=np.int64)  # words of context that the estimate uses
    for n in range(2, order + 1):
        context = np.concatenate(([1], by_end[n - 2][:-1]))
        seen = (by_end[n - 1] >= min_count) & (place >= n - 1)
        # What has no such n-gram pays once for each context length it might have had.
        out = np.where(seen, np.log(np.maximum(by_end[n - 1], 1) / np.maximum(context, 1)),
                       out + np.where(place >= n - 1, math.log(BACKOFF), 0.0))
        known[seen] = n - 1
    return words, np.bincount(owner, weights=out, minlength=len(words)).astype(np.float64)


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES,
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``log_sum`` and ``score`` under the counts of all documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    # A word and the blank after it take two bytes or more.
    bits = min(62, max(32, math.ceil(math.log2(max(2, size * order // 2))) + SPARE_BITS))
    made = cut_lineage(blocks(docs, order, ranges, bits, block_bytes))
    lists = made.select("block", F.explode("lists").alias("l")).select("block", "l.*")
    answers = lists.groupBy("part").applyInPandas(answer_lists, "block string, part long, counts binary")
    # A block's answers are as many as its own n-grams.
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("answers"))
    count = F.udf(lambda body: int(unpack_counts(body).sum()), "long")
    total = made.agg(F.sum(count("words"))).first()[0] or 0
    joined = made.select("block", "ids", "words", "vocabulary", "places").join(answers, "block", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("words", "vocabulary", "places", "answers")}
                words, sums = _log_scores(row, row["answers"] or [], total, order, min_count, bits)
                empty = words == 0
                yield pa.record_batch([
                    one.column("ids").flatten(), pa.array(words), pa.array(sums, mask=empty),
                    pa.array(sums / np.maximum(words, 1), mask=empty)], names=["doc_id", "n_words", "log_sum", "score"])

    return joined.mapInArrow(work, f"doc_id {kind}, n_words long, log_sum double, score double")
