"""Exact substring de-duplication over suffix arrays: bytes of strings that also start in an earlier document go.

Suffix arrays are built by induced sorting (``induced_sort``) shard by shard. What a shard holds is chosen so that equal
strings of ``SPAN`` bytes always meet in one:

1. Every string of SPAN bytes has an anchor, the piece of ``GRAM`` bytes in it with the least hash, leftmost if several.
   Equal strings have equal anchors, one for about sixteen bytes. Anchors in one document only end here.
2. Around each other anchor stands its context, all the strings it is the anchor of. Contexts go to the shard of the
   anchor's hash, equal contexts once per block with their first document. The strings of an anchor in very many
   documents go out one by one, each to the shard of its own hash, so no anchor fills a shard.
3. A shard sorts the suffixes of contexts that share an anchor with another one. Suffixes next to each other with a
   common prefix of SPAN or more are equal strings, whose first document is the least of their contexts'. An anchor with
   a single context has nothing to be compared with, nor have strings at a context's ends whose hash no other string has.
4. Each block gets back the first document of each string and works out its documents' bytes.

Documents are kept in blocks of text in a table bucketed by block, so only hashes, contexts and answers are shuffled.

Empty cases: a null or empty text has no bytes; a null id counts as later than all others; rows with the same id are
not earlier than one another; what is left of a text may end within a character, hence bytes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.batches import binary_text, mix, slices, span_hashes, span_sums
from ledgerlight.llm.induced_sort import BREAK, END, FIRST, sorted_suffixes
from ledgerlight.llm.lm_score import answer_lists, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from ledgerlight.session import cut_lineage, ensure_checkpoint_dir

SPAN, GRAM = 50, 20
BLOCK_BYTES = 4 << 20
#: Text whose anchors meet in one shard. Each block sends a row to each shard, so few shards are few rows; but a small input
#: has ``LEAST_RANGES`` of them, unless each would hold less than ``LEAST_BYTES``.
RANGE_BYTES, LEAST_RANGES, LEAST_BYTES = 16 << 20, 64, 2 << 20
WINDOW_BYTES = 1 << 17  # text whose anchors are looked for at once: its arrays stay in the processor's cache
PIECE_BYTES = 1 << 20  # contexts sorted at once in a shard; memory follows this and not the shard
#: An anchor in more documents than this, whose contexts would fill a piece, sends its strings out one by one.
HOT_DOCS = 15_000
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash of each anchor, the first and last start of the strings it stands for, and their text, in order."""
    empty = np.zeros(0, np.int64)
    wide = SPAN - GRAM + 1
    if len(data) < SPAN:
        return np.zeros(0, np.uint64), empty, empty, empty
    grams = span_sums(data, GRAM)
    # Hash above, place below: the least value is the least hash, leftmost.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[:have - wide], least[wide - have:])
    new = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= SPAN:
            new[a] = True
        new[max(a, b - SPAN + 1):b] = False  # strings that would end in the next text
    first = np.flatnonzero(new)
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, starts[owner + 1] - SPAN)
    return grams[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)], first, last, owner


def block_anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for a block, some texts at a time."""
    out, first = [], 0
    while first < len(starts) - 1:
        last = min(max(first + 1, int(np.searchsorted(starts, starts[first] + WINDOW_BYTES, "right")) - 1), len(starts) - 1)
        base = starts[first]
        keys, a, b, owner = anchors(data[base:starts[last]], starts[first:last + 1] - base)
        out.append((keys, a + base, b + base, owner + first))
        first = last
    found = tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else anchors(data, starts)
    # Anchors have the least hashes around, so most would meet in the first shards if these went by the hash itself.
    return mix(found[0]), *found[1:]


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def blocks(docs: DataFrame, ranges: int, bits: int) -> DataFrame:
    """One row per block: ids, text, lengths, and the list of its anchors with how many of its documents hold each."""
    rows = docs.select("doc_id", "text")

    def block(held: list, name: str) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        data = np.concatenate([h[1] for h in held])
        starts = np.concatenate(([0], np.cumsum(np.concatenate([h[2] for h in held]))))
        keys, _, _, owner = block_anchors(data, starts)
        keys >>= np.uint64(64 - bits)
        turn = np.argsort(keys, kind="stable")  # owners go up as they are
        keys, owner = keys[turn], owner[turn]
        new_key = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        new_pair = new_key | np.concatenate(([True], owner[1:] != owner[:-1])) if len(keys) else new_key
        listed = keys[new_key]
        holders = np.bincount((np.cumsum(new_key) - 1)[new_pair], minlength=len(listed))
        width = (1 << bits) // ranges + 1
        cuts = np.searchsorted(listed, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        lists = [{"part": k, "keys": pack_sorted(listed[a:b]), "times": pack_counts(holders[a:b])}
                 for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.record_batch(
            [pa.array([name]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([_squeeze(data.tobytes())], pa.binary()),
             pa.array([pack_counts(np.diff(starts))], pa.binary()),
             pa.array([lists], pa.list_(pa.struct([("part", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])))],
            names=["block", "ids", "data", "lengths", "lists"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        for texts in slices(batches):
            held.append((texts.rows.column(0), texts.data, np.diff(texts.starts)))
            size += len(texts.data) + 16 * len(texts)
            if size >= BLOCK_BYTES:
                yield block(held, f"{TaskContext.get().partitionId()}-{made}")
                held, size, made = [], 0, made + 1
        if held:
            yield block(held, f"{TaskContext.get().partitionId()}-{made}")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return binary_text(rows).mapInArrow(work, f"block string, ids array<{kind}>, data binary, lengths binary, "
                                              "lists array<struct<part: bigint, keys: binary, times: binary>>")


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """The same rows from a table bucketed by a column: joins on it leave them where they are."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.write.option("path", path).bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


class Block:
    """One block with the anchors that other documents have too, and its distinct contexts by shard, hash and content."""

    def __init__(self, row: dict, ranges: int, bits: int):
        self.ids = row["ids"]
        self.order = np.array([LAST if i is None else int(i) for i in self.ids], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(unpack_counts(row["lengths"]))))
        self.data = np.frombuffer(_open(row["data"]), dtype=np.uint8)
        answers = sorted(row["answers"] or [], key=lambda a: a["part"])
        holders = np.concatenate([unpack_counts(a["counts"]) for a in answers] or [np.zeros(0, np.int64)])
        keys, first, last, owner = block_anchors(self.data, self.starts)
        keys = keys >> np.uint64(64 - bits)
        turn = np.argsort(keys)
        listed = np.empty(len(keys), dtype=np.int64)  # place of each key among the distinct ones, which are the block's list
        listed[turn] = np.cumsum(np.diff(keys[turn], prepend=keys[turn][:1]) != 0)
        held = holders[listed]
        shared, hot = (held > 1) & (held <= HOT_DOCS), held > HOT_DOCS
        width = (1 << bits) // ranges + 1
        part = (keys[shared] // np.uint64(width)).astype(np.int64)
        keys, first, last, owner, hot_first, hot_last, hot_owner = (
            keys[shared], first[shared], last[shared], owner[shared], first[hot], last[hot], owner[hot])
        if len(hot_first):
            count = hot_last - hot_first + 1
            single = _places(hot_first, count)
            own = span_hashes(self.data, single, single + SPAN)
            keys = np.concatenate((keys, own | np.uint64(1 << 63)))
            part = np.concatenate((part, (mix(own) % np.uint64(ranges)).astype(np.int64)))
            first, last = np.concatenate((first, single)), np.concatenate((last, single))
            owner = np.concatenate((owner, np.repeat(hot_owner, count)))
        content = span_hashes(self.data, first, last + SPAN)
        turn = np.lexsort((content, keys, part))
        new = np.ones(len(turn), dtype=bool)
        new[1:] = (part[turn][1:] != part[turn][:-1]) | (keys[turn][1:] != keys[turn][:-1]) | (content[turn][1:] != content[turn][:-1])
        heads = np.flatnonzero(new)
        self.first, self.last, self.owner = first[turn], last[turn], owner[turn]  # of each occurrence
        self.context = np.cumsum(new) - 1  # its context
        self.key, self.part = keys[turn][heads], part[turn][heads]
        self.begin, self.end = self.first[heads], self.last[heads] + SPAN
        self.earliest = np.minimum.reduceat(self.order[self.owner], heads) if len(heads) else np.zeros(0, np.int64)

    def contexts(self) -> Iterator[dict]:
        cuts = np.flatnonzero(np.diff(self.part)) + 1
        for own in np.split(np.arange(len(self.part)), cuts) if len(self.part) else ():
            yield {"part": int(self.part[own[0]]), "keys": pack_sorted(self.key[own]),
                   "lengths": pack_counts(self.end[own] - self.begin[own]),
                   "earliest": pack_counts(self.earliest[own]),
                   "bytes": _squeeze(_spans(self.data, self.begin[own], self.end[own]).tobytes())}

    def removed(self, replies: list) -> np.ndarray:
        """Which bytes go, given the first document of each string of each context."""
        marks = np.zeros(len(self.data) + 1, dtype=np.int32)
        if len(self.part):
            replies = sorted(replies, key=lambda r: r["part"])
            firsts = np.concatenate([np.repeat(unpack_counts(r["firsts"]), unpack_counts(r["runs"])) for r in replies])
            strings = self.end - self.begin - SPAN + 1
            before = np.cumsum(strings) - strings
            count = self.last - self.first + 1
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            gone = firsts[inner + np.repeat(before[self.context], count)] < np.repeat(self.order[self.owner], count)
            at = (inner + np.repeat(self.first, count))[gone]
            marks[at] += 1  # a string has one anchor, so no place comes twice
            marks[at + SPAN] -= 1
        return np.cumsum(marks[:-1]) > 0


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of spans, end to end."""
    size = end - begin
    return data[_places(begin, size)]


def first_documents(data: np.ndarray, size: np.ndarray, earliest: np.ndarray) -> np.ndarray:
    """For contexts end to end: the least ``earliest`` of the contexts that hold each string of SPAN bytes, in order."""
    context = np.repeat(np.arange(len(size)), size)
    text = np.full(len(data) + len(size) + 1, BREAK, dtype=np.uint16)
    text[np.arange(len(data)) + context] = data.astype(np.uint16) + FIRST
    text[-1] = END
    begin = np.cumsum(size + 1) - size - 1
    strings = size - SPAN + 1
    slot = np.full(len(text), -1, dtype=np.int64)  # of strings by where they start
    count = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    slot[count + np.repeat(begin, strings)] = np.arange(strings.sum())
    owner = np.repeat(earliest, strings)
    out = owner.copy()
    open_at, open_least = np.zeros(0, np.int64), LAST  # strings equal to the last one seen
    for at, common in sorted_suffixes(text, SPAN):
        mine = slot[at]
        heads = np.flatnonzero(common < SPAN)
        upto = heads[0] if len(heads) else len(at)
        joined = mine[:upto][mine[:upto] >= 0]
        if len(joined):
            open_at, open_least = np.concatenate((open_at, joined)), min(open_least, int(owner[joined].min()))
        if not len(heads):
            continue
        out[open_at] = open_least
        values = np.where(mine >= 0, owner[np.maximum(mine, 0)], LAST)[upto:]
        least = np.minimum.reduceat(values, heads - upto)
        spread = np.repeat(least, np.diff(heads, append=len(at)))
        whole = mine[upto:]
        out[whole[whole >= 0]] = spread[whole >= 0]
        rest = mine[heads[-1]:]
        open_at, open_least = rest[rest >= 0], int(least[-1])
    out[open_at] = open_least
    return out


def pieces(key: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Contexts in order of key cut into runs of about ``PIECE_BYTES``, none of them within a key.

    Equal strings have equal anchors, so what is sorted together need not be more than that.
    """
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    turn = (np.cumsum(size) - size)[heads] // PIECE_BYTES
    cuts = [*heads[np.concatenate(([True], turn[1:] != turn[:-1]))].tolist(), len(key)]
    return list(zip(cuts[:-1], cuts[1:]))


def _places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from ``begin`` up, one run after the other."""
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


def _comparable(data: np.ndarray, begin: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Of the strings of contexts, in order: whether another one has the same hash. All others stand alone."""
    at = _places(begin, strings)
    hashes = span_hashes(data, at, at + SPAN)
    turn = np.argsort(hashes)
    same = hashes[turn][1:] == hashes[turn][:-1]
    out = np.zeros(len(at), dtype=bool)
    out[turn[1:][same]] = True
    out[turn[:-1][same]] = True
    return out


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """One shard: the first document of each string of each context of each block, as runs."""
    keys = [unpack_sorted(x) for x in group["keys"]]
    sizes = np.concatenate([unpack_counts(x) for x in group["lengths"]])
    earliest = np.concatenate([unpack_counts(x) for x in group["earliest"]])
    data = np.frombuffer(b"".join(_open(x) for x in group["bytes"]), dtype=np.uint8)
    key, end = np.concatenate(keys), np.cumsum(sizes)
    content = span_hashes(data, end - sizes, end)
    turn = np.lexsort((content, key))
    new_key = np.concatenate(([True], key[turn][1:] != key[turn][:-1]))
    new = new_key | np.concatenate(([True], content[turn][1:] != content[turn][:-1]))
    heads = np.flatnonzero(new)
    context = np.empty(len(turn), dtype=np.int64)
    context[turn] = np.cumsum(new) - 1
    least, chosen = np.minimum.reduceat(earliest[turn], heads), turn[heads]
    kinds = np.bincount((np.cumsum(new_key) - 1)[heads])  # contexts of each anchor
    several = np.flatnonzero(kinds[(np.cumsum(new_key) - 1)[heads]] > 1)
    strings = sizes[chosen] - SPAN + 1
    # A context is one run of strings that have its own first document, unless some stand in others too.
    runs, values, lengths = np.ones(len(chosen), dtype=np.int64), least, strings
    if len(several):
        own, count = chosen[several], strings[several]
        firsts = np.repeat(least[several], count)
        before = np.cumsum(count) - count
        met = np.flatnonzero(_comparable(data, end[own] - sizes[own], count))
        holder = np.searchsorted(before, met, "right") - 1
        cuts = np.flatnonzero(np.concatenate(([True], holder[1:] != holder[:-1]))) if len(met) else met
        # Of each context, from the first to the last such string.
        low, high, holder = met[cuts], met[np.append(cuts[1:], len(met)) - 1] if len(met) else met, holder[cuts]
        begin = (end[own] - sizes[own])[holder] + low - before[holder]
        size = high - low + SPAN
        for a, b in pieces(key[own][holder], size) if len(met) else ():
            firsts[_places(low[a:b], size[a:b] - SPAN + 1)] = first_documents(
                _spans(data, begin[a:b], begin[a:b] + size[a:b]), size[a:b], least[several][holder[a:b]])
        new_run = np.concatenate(([True], firsts[1:] != firsts[:-1]))
        new_run[before] = True
        run_at = np.flatnonzero(new_run)
        runs[several] = np.add.reduceat(new_run, before, dtype=np.int64)
        values, lengths = np.repeat(least, runs), np.repeat(strings, runs)
        where = _places((np.cumsum(runs) - runs)[several], runs[several])
        values[where], lengths[where] = firsts[run_at], np.diff(run_at, append=len(firsts))
    first_run = np.cumsum(runs) - runs
    out, done = [], 0
    for own in keys:
        mine = context[done:done + len(own)]
        done += len(own)
        which = _places(first_run[mine], runs[mine])
        value = values[which]
        turns = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        out.append((pack_counts(value[turns]), pack_counts(np.add.reduceat(lengths[which], turns))))
    pa.default_memory_pool().release_unused()
    return pd.DataFrame({"block": group["block"], "part": group["part"],
                         "firsts": [a for a, _ in out], "runs": [b for _, b in out]})


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked, ``kept``.

    ``doc_id`` is a whole number.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES), min(LEAST_RANGES, -(-size // LEAST_BYTES)))
    # Anchors that meet by chance only make work; one in a thousand does.
    bits = min(62, max(24, math.ceil(math.log2(max(2, size // 8))) + 10))
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (4 * BLOCK_BYTES)))
    made = bucketed(blocks(docs, ranges, bits), "block", buckets)
    lists = made.select("block", F.explode("lists").alias("l")).select("block", "l.*")
    answers = cut_lineage(lists.groupBy("part").applyInPandas(answer_lists, "block string, part long, counts binary"))
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("answers"))
    known = made.drop("lists").join(by_block, "block", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = [{"block": row["block"], **x} for x in Block(row, ranges, bits).contexts()]
                if found:
                    yield pa.RecordBatch.from_pylist(found)
                pa.default_memory_pool().release_unused()  # blocks are large, and workers live on

    contexts = known.mapInArrow(send, "block string, part long, keys binary, lengths binary, earliest binary, bytes binary")
    replies = contexts.groupBy("part").applyInPandas(_resolve, "block string, part long, firsts binary, runs binary")
    replies = cut_lineage(replies).groupBy("block").agg(F.collect_list(F.struct("part", "firsts", "runs")).alias("replies"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                own = Block(row, ranges, bits)
                gone = own.removed(row["replies"] or [])
                totals = np.concatenate(([0], np.cumsum(gone)))
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                heads = own.starts[:-1][np.diff(own.starts) > 0]
                rise[heads] = gone[heads]
                spans = np.concatenate(([0], np.cumsum(rise)))
                kept = [own.data[a:b][~gone[a:b]].tobytes() for a, b in zip(own.starts[:-1], own.starts[1:])]
                columns = [one.column("ids").flatten(), pa.array(np.diff(own.starts)), pa.array(np.diff(totals[own.starts])),
                           pa.array(np.diff(spans[own.starts])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_bytes:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.record_batch(columns, names=names)
                pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return known.join(replies, "block", "left").mapInArrow(
        finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
