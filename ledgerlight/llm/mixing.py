"""Mixing sources to target weights.

Each source's documents, in a fixed order, are one long run of words, packed into blocks of ``block_words`` words. A
source's slots run through its blocks in pseudorandom order, once per pass, until its target is reached; the last slot
is cut to fit. Slots are dealt to output shards by multinomial draws of source counts, and the blocks are joined to the
slots by their index.

Empty cases: a null or empty text has no words and is never taken; a null source is a source of its own, last in order;
without words every target is 0. Rows with the same id are kept apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.binding import bind
from ledgerlight.llm.batches import binary_text, mix, slices, words
from ledgerlight.session import cut_lineage

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
RANGES = 8192  # of shards, which the driver splits them into
#: Rows of a source between two running sums. Only these sums are put in order source by source.
ORDER_ROWS = 2_000


class Plan(NamedTuple):
    """One source: its place, words, target and blocks."""

    source: str | None
    place: int
    size: int
    target: float
    blocks: int
    slots: int  # full passes over the blocks, and part of one


def fill_targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted per source: ``share`` of all words by weight, none above ``most`` times its own words.

    What a full source cannot take is shared among the others by weight, until none is above.
    """
    left = min(share, most) * sum(sizes)
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a four-round Feistel network, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, n = index.astype(np.uint64), n.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix(right + key[todo] + np.uint64(r << 40)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``finger``, a hash of the text that tells rows with one id apart."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.col(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("finger"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            columns = [texts.rows.column(texts.rows.schema.get_field_index(c)) for c in ("doc_id", "source", "finger")]
            yield pa.record_batch([*columns, pa.array(words(texts, "space").counts, pa.int64())],
                                  names=["doc_id", "source", "finger", "size"])

    schema = rows.select("doc_id", "source", "finger", F.lit(0).cast("long").alias("size")).schema
    return binary_text(rows).mapInArrow(count, schema)


def with_offsets(rows: DataFrame) -> DataFrame:
    """Adds ``offset``: the words of the same source that stand before the row.

    Rows are put in groups of about ``ORDER_ROWS`` by a hash; sums run over the groups, then within each, so no source
    is ever sorted in one task.
    """
    groups = max(1, rows.count() // ORDER_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "finger"), F.lit(groups)))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")).withColumn(
        "part_offset", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size"))
    order = Window.partitionBy("source", "part").orderBy(F.col("doc_id").asc_nulls_last(), "finger", "tie")
    inside = rows.withColumn("tie", F.monotonically_increasing_id()).withColumn(
        "in_part", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = inside.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))
                                    & (F.col("r.part") == F.col("s.part")))
    return joined.select("r.doc_id", "r.source", "r.finger", "r.size",
                         (F.col("in_part") + F.col("part_offset")).alias("offset"))


def plan_sources(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, block_words: int) -> list[Plan]:
    """One entry per source, by code point, null last. Sources are few; one row each comes to the driver."""
    found = [(r["source"], int(r["n"])) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    out = []
    for place, ((source, size), target) in enumerate(zip(found, targets, strict=True)):
        blocks = -(-size // block_words)
        full, rest = divmod(min(round(target), int(most * size)), max(size, 1))
        out.append(Plan(source, place, size, target, blocks, full * blocks + min(blocks, -(-rest // block_words) + 1)
                        if rest else full * blocks))
    return out


class Deal(NamedTuple):
    """Shards ``low`` up to ``high``: slots of each source before them, and in them."""

    low: int
    high: int
    before: np.ndarray
    counts: np.ndarray


def halved(deal: Deal, most: int, total: int, shard_slots: int, seed: int) -> Iterator[Deal]:
    """A range of shards cut in halves until none has more than ``most``, in order.

    The left half's counts are a multinomial draw over what the range has of each source, the right half has the rest; so
    a shard's counts are what the seed and its place say, wherever they are worked out.
    """
    todo = [deal]
    while todo:
        d = todo.pop()
        if d.high - d.low <= most:
            yield d
            continue
        middle = (d.low + d.high) // 2
        room = min(middle * shard_slots, total) - d.low * shard_slots
        left = _draw(np.random.default_rng([seed, d.low, d.high]), room, d.counts)
        todo += [Deal(middle, d.high, d.before + left, d.counts - left), Deal(d.low, middle, d.before, left)]


def deal_slots(spark, plans: list[Plan], seed: int, block_words: int = BLOCK_WORDS,
               shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """All slots: ``shard``, ``place`` of the source, ``block`` and ``length``, the words taken from the block's start.

    Source counts per shard are multinomial draws over what each source has left, so all slots are dealt out. The driver
    splits the shards into a bounded number of ranges; tasks split a range further and work out its slots.
    """
    total = sum(p.slots for p in plans)
    counts = np.array([p.slots for p in plans], dtype=np.int64)
    shards = -(-total // shard_slots)
    whole = Deal(0, shards, np.zeros_like(counts), counts)
    ranges = list(halved(whole, max(1, -(-shards // RANGES)), total, shard_slots, seed)) if shards else []
    facts = {p.place: (p.blocks, p.size, round(p.target)) for p in plans}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
        for batch in batches:
            for low, high, before, mine in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                known = Deal(low, high, np.array(before, dtype=np.int64), np.array(mine, dtype=np.int64))
                for d in halved(known, 1, total, shard_slots, seed):
                    for place in np.flatnonzero(d.counts).tolist():
                        yield d.low, place, int(d.before[place]), int(d.counts[place])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, place, first, n in runs(batches):
            blocks, size, target = facts[place]
            at = np.arange(first, first + n)
            lap, key = at // blocks, mix(np.array([seed * 1_000_003 + place], dtype=np.uint64))
            full = np.full(n, blocks)
            # The last block of a source may be short. Where it stands in the order moves what comes after it.
            block = permuted(at % blocks, full, np.repeat(key, n))
            length = np.where(block == blocks - 1, size - (blocks - 1) * block_words, block_words)
            short = block_words - (size - (blocks - 1) * block_words)
            place_of_last = _place_of_last(blocks, key[0]) if short else blocks
            before = lap * size + (at % blocks) * block_words - np.where(at % blocks > place_of_last, short, 0)
            length = np.clip(target - before, 0, length)
            yield pa.record_batch([pa.array(np.full(n, shard)), pa.array(np.full(n, place)), pa.array(block),
                                   pa.array(length)], names=["shard", "place", "block", "length"])

    frame = spark.createDataFrame([(d.low, d.high, d.before.tolist(), d.counts.tolist()) for d in ranges],
                                  "low long, high long, before array<long>, counts array<long>")
    tasks = max(1, min(len(ranges), total // 200_000 + 1))
    out = frame.repartition(tasks).mapInArrow(slots, "shard long, place long, block long, length long")
    return out.filter(F.col("length") > 0)


def _draw(rng: np.random.Generator, n: int, left: np.ndarray) -> np.ndarray:
    """A multinomial draw of n by what is left; what exceeds it is drawn again from the rest."""
    out = np.zeros_like(left)
    while n:
        rest = left - out
        drawn = np.minimum(rng.multinomial(n, rest / rest.sum()), rest)
        out += drawn
        n -= int(drawn.sum())
    return out


def _place_of_last(blocks: int, key: np.uint64) -> int:
    """Where the permutation puts the last block: the network run backwards, walked until it lands inside."""
    half = max(1, (int(np.ceil(np.log2(max(blocks, 2)))) + 1) // 2)
    mask, value = (1 << half) - 1, blocks - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(4)):
            moved = int(mix(np.array([left], dtype=np.uint64) + key + np.uint64(r << 40))[0]) & mask
            left, right = right ^ moved, left
        value = (left << half) | right
        if value < blocks:
            return value


class Mix(NamedTuple):
    """``rows``: documents with ``place``, ``size``, ``offset``; ``slots``: the mix; ``plans``: one per source."""

    rows: DataFrame
    slots: DataFrame
    plans: list[Plan]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                seed: int = 17, block_words: int = BLOCK_WORDS) -> Mix:
    rows = cut_lineage(with_offsets(cut_lineage(sized(docs))))
    plans = plan_sources(rows, weights, share, most, block_words)
    spark = docs.sparkSession
    places = spark.createDataFrame([(p.source, p.place, p.size, float(p.target)) for p in plans],
                                   "source string, place long, source_size long, target double")
    placed = rows.alias("r").join(places.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")), "left").select(
        "r.*", "p.place", "p.source_size", "p.target")
    # Written, so that joins go by the real size of the slots and not by that of the few rows they are made from.
    return Mix(placed, cut_lineage(deal_slots(spark, plans, seed, block_words)), plans)


def _blocks_of(rows: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block it reaches into: ``block``, and the part of the block that is the document's."""
    last: Column = F.expr(f"(offset + size - 1) div {block_words}")
    cut = rows.filter(F.col("size") > 0).withColumn(
        "block", F.explode(F.sequence(F.expr(f"offset div {block_words}"), last)))
    begin = F.col("block") * block_words
    return cut.select("doc_id", "finger", "place", "offset", "block",
                      F.greatest(F.col("offset") - begin, F.lit(0)).alias("from"),
                      F.least(F.col("offset") + F.col("size") - begin, F.lit(block_words)).alias("to"))


def taken_words(mixed: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, its words in the mix with repeats."""
    pieces = _blocks_of(mixed.rows, block_words)
    part = F.greatest(F.least(F.col("to"), F.col("length")) - F.col("from"), F.lit(0))
    sums = pieces.join(mixed.slots, ["place", "block"]).groupBy("place", "offset", "doc_id", "finger").agg(
        F.sum(part).alias("taken"))
    rows = mixed.rows.alias("r").join(
        sums.alias("s"), (F.col("r.size") > 0) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id"))
        & (F.col("r.finger") == F.col("s.finger")) & (F.col("r.place") == F.col("s.place"))
        & (F.col("r.offset") == F.col("s.offset")), "left")
    return rows.select("r.doc_id", "r.size", "r.source_size", "r.target",
                       F.coalesce("s.taken", F.lit(0)).cast("long").alias("taken"))


def packed_blocks(docs: DataFrame, mixed: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: one row per slot with ``shard``, ``source``, ``block``, ``n_words`` and ``text``, single-blanked.

    ``doc_ids`` has the documents of the text and ``n_words``, the words taken of each, by id, null last. A document is cut
    into the parts of its blocks where it stands; a block has no more parts than words.
    """
    # One key that is never null, so that finding repeated rows and joining share one shuffle of the texts.
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("key")
    keyed = docs.select(key, "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("finger")).dropDuplicates(["key", "finger"])
    rows = mixed.rows.filter(F.col("size") > 0).select(
        key, "doc_id", "finger", "place", "source", "offset", "size").join(keyed, ["key", "finger"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            place, source, offset, doc_id = (texts.rows.column(i) for i in (0, 1, 2, 3))
            whose, blocks, offsets, sizes, parts = [], [], [], [], []
            for i, first in enumerate(offset.to_pylist()):
                own = texts.text(i).split()  # bytes.split cuts at the same blanks
                for block in range(first // block_words, (first + len(own) - 1) // block_words + 1):
                    begin = max(block * block_words - first, 0)
                    part = own[begin:(block + 1) * block_words - first]
                    whose.append(i)
                    blocks.append(block)
                    offsets.append(first)
                    sizes.append(len(part))
                    parts.append(b" ".join(part))
            take = pa.array(whose, pa.int64())
            yield pa.record_batch([place.take(take), source.take(take), pa.array(blocks, pa.int64()),
                                   pa.array(offsets, pa.int64()), doc_id.take(take), pa.array(sizes, pa.int64()),
                                   pa.array(parts, pa.binary())],
                                  names=["place", "source", "block", "offset", "doc_id", "size", "part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = binary_text(rows.select("place", "source", "offset", "doc_id", "text")).mapInArrow(
        cut, f"place long, source string, block long, offset long, doc_id {kind}, size long, part binary")
    blocks = pieces.groupBy("place", "source", "block").agg(F.array_sort(F.collect_list(F.struct(
        "offset", F.col("part").cast("string").alias("part"), "doc_id", "size"))).alias("parts")).select(
        "place", "source", "block", F.array_join("parts.part", " ").alias("text"),
        F.transform("parts", lambda x: F.struct(
            x["doc_id"].alias("doc_id"), F.greatest(x["offset"] - F.col("block") * block_words, F.lit(0)).alias("from"),
            x["size"].alias("size"))).alias("parts"))
    short = F.col("length") < F.size(F.split("text", " "))
    return mixed.slots.join(blocks, ["place", "block"]).select(
        "shard", "source", "block", F.col("length").alias("n_words"),
        F.when(short, F.expr("substring_index(text, ' ', CAST(length AS INT))")).otherwise(F.col("text")).alias("text"),
        _taken_of(F.col("parts"), F.col("length")).alias("doc_ids"))


def _taken_of(parts: Column, length: Column) -> Column:
    """``doc_id`` and ``n_words`` of each document with words among the first ``length`` of a block."""

    def sums(used: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(F.transform(used, lambda x: x["doc_id"]))), lambda i: F.struct(
            i.alias("doc_id"), F.aggregate(F.filter(used, lambda x: x["doc_id"].eqNullSafe(i)), F.lit(0).cast("long"),
                                           lambda n, x: n + F.least(x["size"], length - x["from"])).alias("n_words")))

    return bind(F.filter(parts, lambda x: x["from"] < length), sums)
