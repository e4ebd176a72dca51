"""Jaccard join of word shingle sets, size-aware: light sets by subsets, heavy sets by inverted lists.

Two sets of sizes s and t link when their overlap reaches o(s, t). Equal sets are one node from the start.

*Light sets* list all their subsets of size o(s, t), for every t they may link with. Sets that list the same subset are
linked, with nothing left to check.

*Heavy sets* are cut into hash parts, one more than two linked sets can differ in, so some part is the same in both.
An inverted list holds the sets with one and the same part: unlike the list of a single shingle, it holds hardly
anything but near copies, even where a passage stands in a third of all documents. A list is scanned from its least
member, whose pairs are checked on the texts. Where members are still in several groups, all pairs of different groups
are compared by sketches, bits that differ in no more places than the sets do in elements: first as many pairs are
checked on the texts as would join the groups, then those that remain between groups. Every pair that could join two
groups is checked, and a list of n near copies costs about n checks.

The size where heavy begins is the one with the least cost over the sizes found: subsets listed by light sets, list
entries and checks of heavy ones.

Empty cases: a text without words, or none, has no shingles and no links; a text with fewer words than a shingle is one
shingle; repeated rows are equal sets. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.batches import Texts, binary_text, distinct, gram_hashes, mix, slices, within, word_hashes
from ledgerlight.llm.components import connected
from ledgerlight.session import cut_lineage

#: No set of this size or more is light; sizes below are counted to choose where heavy begins.
LIGHT_END = 64
#: Cost of a list entry, with its share of checks, against a listed subset.
ENTRY_COST = 3
#: Members of a list that meet as many others in one task.
LIST_BLOCK = 1024


class Rule(NamedTuple):
    """Shingle width and the similarity, ``num`` / ``den``, from which two sets link."""

    width: int
    num: int
    den: int

    def overlap(self, s: int, t: int) -> int:
        return -(-self.num * (s + t) // (self.num + self.den))

    def apart(self, s: int, t: int) -> int:
        """Most elements in one of two linked sets but not in both."""
        return (s + t) * (self.den - self.num) // (self.den + self.num)

    def partners(self, s: int) -> range:
        return range(-(-s * self.num // self.den), s * self.den // self.num + 1)


class Level(NamedTuple):
    """Sizes from ``low`` to ``high``, and the parts of lists where sets of this level and the one below meet."""

    low: int
    high: int
    parts: int
    spare: int  # parts that agree beyond doubt


def levels(rule: Rule, up_to: int) -> list[Level]:
    """Levels so wide that linked sets are in the same or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= up_to:
        starts.append(starts[-1] * rule.den // rule.num + 1)
    out = []
    for i, low in enumerate(starts):
        high = low * rule.den // rule.num
        apart = rule.apart(high, high)
        # Empty parts agree in many sets. With as many parts to spare as may be empty, lists need none of them.
        smallest = starts[max(i - 1, 0)]
        empty = (apart + 1) * math.exp(-smallest / (apart + 1))
        spare = 1 + math.ceil(empty + 3 * math.sqrt(empty))
        out.append(Level(low, high, apart + spare, spare))
    return out


def shingle_sets(texts: Texts, width: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    found, hashes = word_hashes(texts, "space")
    where, owner = within(found.before, width)
    grams = gram_hashes(hashes, width)[where]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if ends[i + 1] > ends[i]:
            out.append(distinct(grams[ends[i]:ends[i + 1]]))
        else:
            own = hashes[found.before[i]:found.before[i + 1]]
            out.append(gram_hashes(own, len(own)) if len(own) else own)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _node(elements: np.ndarray) -> np.uint64:
    return mix(np.array([elements.sum(dtype=np.uint64) + np.uint64(len(elements))], dtype=np.uint64))[0]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per document ``doc_id``, ``finger`` (hash of the text), ``n`` (set size) and ``node``, which equal sets share."""
    rows = docs.select("doc_id", F.col("text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("finger"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            sets = shingle_sets(texts, width)
            nodes = np.array([_node(mix(s)) for s in sets], dtype=np.uint64)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            yield pa.record_batch([texts.rows.column(0), texts.rows.column(2), pa.array(n), _signed(nodes)],
                                  names=["doc_id", "finger", "n", "node"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("finger", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])
    return binary_text(rows).mapInArrow(work, schema)


def subset_cost(rule: Rule, s: int) -> int:
    return sum(math.comb(s, s - rule.overlap(s, t)) for t in rule.partners(s))


def heavy_from(rule: Rule, histogram: dict[int, int], steps: list[Level]) -> int:
    """Index of the first level whose sets are heavy: the cheapest over the sizes found."""
    def cost(first: int) -> int:
        total = 0
        for size, count in histogram.items():
            at = next(i for i, x in enumerate(steps) if x.low <= size <= x.high)
            light = subset_cost(rule, size) if at < first else 0
            lists = sum(steps[i].parts for i in (at, at + 1) if i >= first)
            total += count * (light + ENTRY_COST * lists)
        return total

    return min((i for i, x in enumerate(steps) if x.low <= LIGHT_END), key=cost)


def subset_keys(elements: np.ndarray, rule: Rule, largest: int) -> Iterator[tuple[np.ndarray, int]]:
    """Hashes of a light set's subsets, by partner size; 1 where partners have its own size, else 2."""
    s, total = len(elements), elements.sum(dtype=np.uint64)
    for t in rule.partners(s):
        left_out = s - rule.overlap(s, t)
        if t > largest or left_out < 0 or rule.overlap(s, t) > t or (t == s and not left_out):
            continue
        gone = np.array([elements[list(c)].sum(dtype=np.uint64) for c in combinations(range(s), left_out)]
                        if left_out else [0], dtype=np.uint64)
        yield mix(mix(total - gone) + np.uint64(min(s, t) * 4096 + max(s, t))), 1 if s == t else 2


def list_keys(elements: np.ndarray, level: int, step: Level) -> np.ndarray:
    """Hashes of the parts of a set, for the lists of one level."""
    part = (mix(elements + np.uint64(level + 1)) % np.uint64(step.parts)).astype(np.int64)
    sums = np.zeros(step.parts, dtype=np.uint64)
    np.add.at(sums, part, elements)
    filled = np.zeros(step.parts, dtype=bool)
    filled[part] = True
    if step.parts - filled.sum() >= step.spare:  # all that agrees may be empty
        filled[:] = True
    which = np.flatnonzero(filled).astype(np.uint64)
    return mix(mix(sums[filled]) + (which << np.uint64(20)) + np.uint64(level + 1))


def entries(docs: DataFrame, rule: Rule, steps: list[Level], heavy: int) -> DataFrame:
    """``key``, ``kind`` (0 a list, else subsets), ``node`` and ``n``, the set's size or the list's level."""
    largest = steps[heavy].low - 1
    lows = np.array([x.low for x in steps])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            keys, kinds, nodes, sizes = [], [], [], []

            def add(found: np.ndarray, kind: int, node: np.uint64, size: int) -> None:
                keys.append(found)
                kinds.append(np.full(len(found), kind, dtype=np.int32))
                nodes.append(np.full(len(found), node, dtype=np.uint64))
                sizes.append(np.full(len(found), size, dtype=np.int64))

            for shingles in shingle_sets(texts, rule.width):
                if not len(shingles):
                    continue
                elements = mix(shingles)
                node, at = _node(elements), int(np.searchsorted(lows, len(elements), "right")) - 1
                for level in (at, at + 1):
                    if level >= heavy:
                        add(list_keys(elements, level, steps[level]), 0, node, level)
                if at < heavy:
                    for found, kind in subset_keys(elements, rule, largest):
                        add(found, kind, node, len(elements))
            if keys:
                yield pa.record_batch([_signed(np.concatenate(keys)), pa.array(np.concatenate(kinds)),
                                       _signed(np.concatenate(nodes)), pa.array(np.concatenate(sizes))],
                                      names=["key", "kind", "node", "n"])

    return binary_text(docs.select("text")).mapInArrow(work, "key long, kind int, node long, n long")


def sketch(elements: np.ndarray, level: int, bits: int) -> bytes:
    """Parities of the numbers of elements in ``bits`` cells. Each element that is in one of two sets only changes one."""
    cell = (mix(elements ^ np.uint64(0x5851F42D4C957F2D + level)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch_bits(step: Level) -> int:
    """So many cells that few differences fall on one another."""
    return 1 << max(6, (8 * step.parts - 1).bit_length())


def node_texts(nodes: DataFrame, reps: DataFrame, docs: DataFrame, rule: Rule, steps: list[Level]) -> DataFrame:
    """Per node ``n``, ``level``, its sketches for its own level and the next, and ``body``, a text it stands for."""
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"),
                        F.col("text").cast("binary").alias("text"))
    named = nodes.join(reps.select("node", "rep"), "node").join(
        texts, (F.col("mark") == F.col("rep.finger")) & F.col("id").eqNullSafe(F.col("rep.doc_id")))
    lows = np.array([x.low for x in steps])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            sizes, at, own, above = [], [], [], []
            for shingles in shingle_sets(texts, rule.width):
                level = int(np.searchsorted(lows, len(shingles), "right")) - 1
                sizes.append(len(shingles))
                at.append(level)
                own.append(sketch(shingles, level, sketch_bits(steps[level])))
                above.append(sketch(shingles, level + 1, sketch_bits(steps[level + 1])))
            yield pa.record_batch([texts.rows.column(0), pa.array(sizes, pa.int64()), pa.array(at, pa.int64()),
                                   pa.array(own, pa.binary()), pa.array(above, pa.binary()), texts.rows.column(1)],
                                  names=["node", "n", "level", "own", "above", "body"])

    found = named.select("node", "text").mapInArrow(work, "node long, n long, level long, own binary, above binary, body binary")
    return found.dropDuplicates(["node"])


def _cells(own: pa.Array, above: pa.Array, level: np.ndarray, at: int) -> np.ndarray:
    """Sketches for level ``at`` as rows of 64-bit words."""
    rows = [(a if x == at else b).as_py() for a, b, x in zip(own, above, level.tolist(), strict=True)]
    return np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(len(rows), -1)


def plausible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose sketches differ in no more cells than two linked sets may differ in elements."""
    named = pairs
    for side in ("a", "b"):
        named = named.join(nodes.select(F.col("node").alias(side), F.struct("n", "level", "own", "above").alias(f"of_{side}")), side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (na, la, oa, ua), (nb, lb, ob, ub) = (
                [batch.column(f"of_{s}").field(f) for f in ("n", "level", "own", "above")] for s in ("a", "b"))
            la, lb = la.to_numpy(), lb.to_numpy()
            keep, level = np.zeros(batch.num_rows, dtype=bool), np.maximum(la, lb)
            for at in np.unique(level):
                rows = np.flatnonzero((level == at) & (np.abs(la - lb) < 2))
                if len(rows):
                    take = pa.array(rows)
                    x, y = (_cells(o.take(take), u.take(take), own[rows], at) for o, u, own in ((oa, ua, la), (ob, ub, lb)))
                    apart = np.bitwise_count(x ^ y).sum(axis=1)
                    most = (na.to_numpy()[rows] + nb.to_numpy()[rows]) * (rule.den - rule.num) // (rule.den + rule.num)
                    keep[rows] = apart <= most
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return named.select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def checked(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of nodes whose texts' sets do link."""
    named = pairs
    for side in ("a", "b"):
        named = named.join(nodes.select(F.col("node").alias(side), F.col("body").alias(f"text_{side}")), side)

    def sets(rows: pa.RecordBatch, column: str) -> list[np.ndarray]:
        return [s for texts in slices(iter([rows]), column) for s in shingle_sets(texts, rule.width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                keep = []
                for x, y in zip(sets(rows, "text_a"), sets(rows, "text_b"), strict=True):
                    both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
                    keep.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
                yield rows.select(["a", "b"]).filter(pa.array(keep))

    return named.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, in order, join two groups not joined by pairs before."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def across_groups(lists: DataFrame, groups: DataFrame, nodes: DataFrame, rule: Rule, forest: bool,
                  block: int = LIST_BLOCK) -> DataFrame:
    """Pairs of a list that are in different groups and whose sketches may link; with ``forest``, only as many as it
    takes to join what such pairs join.

    Lists are cut into blocks and blocks met two by two, so a task holds two blocks; pairs are compared there as bits.
    """
    named = lists.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter(
        "low < high").select("key", F.ceil(F.col("size") / block).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = named.join(open_, "key").withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
                     (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"),
                     "node", "root", "at").join(nodes.select("node", "n", "level", "own", "above"), "node")
    met = met.select("cell", "left", "right", "node", "root", "n",
                     F.when(F.col("at") == F.col("level"), F.col("own")).otherwise(F.col("above")).alias("bits"))
    met = met.repartition("cell").sortWithinPartitions("cell", "node")

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        node, root, n = (rows.column(c).to_numpy() for c in ("node", "root", "n"))
        left, right = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        found = []
        cells = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        for i in range(len(node) - 1):
            ys = np.arange(i + 1, len(node))
            ys = ys[(root[ys] != root[i]) & ((left[i] & right[ys]) | (right[i] & left[ys]))]
            if len(ys):
                apart = np.bitwise_count(cells[ys] ^ cells[i]).sum(axis=1)
                ys = ys[apart <= (n[ys] + n[i]) * (rule.den - rule.num) // (rule.den + rule.num)]
                found.append(np.stack((np.minimum(node[ys], node[i]), np.maximum(node[ys], node[i]),
                                       np.minimum(root[ys], root[i]), np.maximum(root[ys], root[i]))))
        a, b, ra, rb = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        keep = _forest(ra, rb) if forest else np.ones(len(a), dtype=bool)
        return pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            rows = table.to_batches()[0] if table.num_rows else batch
            cell = rows.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist()]
            for first, last in zip(cuts, cuts[1:]):
                yield compare(rows.slice(first, last - first))
            held = rows.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield compare(held)

    return met.mapInArrow(work, "a long, b long").distinct()


def different(lists: DataFrame) -> DataFrame:
    """One list of each set of members: near copies agree in most parts and so meet in many lists."""
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)]
    members = lists.groupBy("key").agg(F.count("*").alias("size"), *hashes)
    return lists.join(members.groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).select("key"), "key")


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = LIST_BLOCK) -> DataFrame:
    """Per document ``doc_id``, ``finger``, ``n_shingles`` and ``component_id``, the least id linked to it in any steps."""
    rule = Rule(width, num, den)
    rows = cut_lineage(describe(docs, width))
    sets = rows.filter("n > 0")
    reps = sets.groupBy("node").agg(F.min(F.struct("doc_id", "finger")).alias("rep"), F.min("doc_id").alias("least"))
    histogram = {r["n"]: r["count"] for r in sets.filter(F.col("n") < LIGHT_END).groupBy("n").count().collect()}
    steps = levels(rule, sets.agg(F.max("n")).first()[0] or 1)
    heavy = heavy_from(rule, histogram, steps)
    # One exchange serves both uses, which therefore read the same columns.
    entered = entries(docs, rule, steps, heavy).repartition("key")
    shared = entered.groupBy("key").agg(
        F.min("node").alias("pivot"), F.max("node").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.max("kind").alias("of")).filter((F.col("pivot") < F.col("last")) & ((F.col("of") < 2) | (F.col("low") < F.col("high"))))
    met = cut_lineage(entered.join(shared.select("key", "pivot"), "key").select("key", "kind", "node", "n", "pivot").distinct())
    sure = met.filter("kind > 0 AND node != pivot").select(*_pairs("node", "pivot")).distinct()
    lists = cut_lineage(different(met.filter("kind = 0").select("key", "node", F.col("n").alias("at"))))
    nodes = cut_lineage(node_texts(lists.select("node").distinct(), reps, docs, rule, steps))
    pairs = met.filter("kind = 0 AND node != pivot").select(*_pairs("node", "pivot")).distinct()
    links = cut_lineage(sure.unionAll(checked(plausible(pairs, nodes, rule), nodes, rule)).distinct())
    groups = connected(links)
    for forest in (True, False):
        found = cut_lineage(across_groups(lists, groups, nodes, rule, forest, block))
        links = cut_lineage(links.unionAll(checked(found, nodes, rule)))
        groups = connected(links)
    owners = reps.join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = owners.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(owners.join(lowest, "root").select("node", "component_id"))
    linked = sets.join(named, "node").select("doc_id", "finger", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionAll(rows.filter("n = 0").select("doc_id", "finger", F.col("n").alias("n_shingles"),
                                                       F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns as they were, without those linked to one with a lower id.

    Rows that share the lowest id and their text all stay.
    """
    kept = near_groups(docs, width, num, den).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id"), F.col("finger").alias("_finger")).distinct()
    finger = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (finger == kept["_finger"]), "left_semi")
