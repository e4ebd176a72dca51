"""Benchmark decontamination by a generalised suffix automaton over item words.

The items' normalised words feed one automaton, document words are streamed through it, and at each word it knows the
longest stretch ending there that some item contains. A stretch of ``window`` words is a hit; an item shorter than a
window counts when it occurs whole. Hit spans are cut out, and a document hit over more than ``max_coverage`` of its
words goes altogether.

Empty cases: a null or empty text has no words and no hits; an item without words never occurs; without items nothing
is hit; repeated items and repeated documents each count as they stand (an item id counts once per document).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.batches import LOWER_BYTES, PLAIN_WORDS, binary_text, slices

WINDOW = 10
#: Words of items in one automaton, which bounds what a task holds; more items make more automata, run in turn.
AUTOMATON_WORDS = 100_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of several word sequences, with the items that windows belong to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.shortest = min((min(len(s), window) for _, s in sequences), default=0)
        self.items: dict[int, set[str]] = {}  # by the state of a whole window
        short: dict[int, list[tuple[int, str]]] = {}
        for name, sequence in sequences:
            state = matched = 0
            for word in sequence:
                state, matched = self.step(state, matched, word)
                if matched >= window:
                    self.items.setdefault(self.holding(state, window), set()).add(name)
            if len(sequence) < window:
                short.setdefault(self.holding(state, len(sequence)), []).append((len(sequence), name))
        # Short items that end wherever a state is reached: its own and those of all its suffixes.
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                if found := short.get(state, []) + self.short.get(self.link[state], []):
                    self.short[state] = found

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            found = self.next[last][word]
            return found if self.length[found] == self.length[last] + 1 else self._split(last, found, word)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            found = self.next[at][word]
            self.link[new] = found if self.length[found] == self.length[at] + 1 else self._split(at, found, word)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, found: int, word: int) -> int:
        """A state for the shorter strings of ``found``, those that continue ``at``."""
        clone = self._state(self.length[at] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = clone
        while at != -1 and self.next[at].get(word) == found:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest match that ends with the word."""
        following = self.next[state].get(word)
        while following is None and state:
            state = self.link[state]
            matched = self.length[state]
            following = self.next[state].get(word)
        return (0, 0) if following is None else (following, matched + 1)

    def holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match that is at least as long."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def search(self, words: list[bytes], hit: np.ndarray) -> set[str]:
        """Marks the hit words and returns the items found."""
        get = self.ids.get
        known = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        found: set[str] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < self.shortest:
                continue  # no window fits between words that no item has
            state = matched = 0
            for i, word in enumerate(known[start:end].tolist(), start):
                state, matched = self.step(state, matched, word)
                if matched >= self.window:
                    hit[i - self.window + 1:i + 1] = True
                    found |= self.items[self.holding(state, self.window)]
                for length, name in self.short.get(state, ()):
                    if length <= matched:
                        hit[i - length + 1:i + 1] = True
                        found.add(name)
        return found


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN_WORDS).split()


def build_automata(benchmark: DataFrame, window: int, max_words: int = AUTOMATON_WORDS) -> list:
    """One broadcast automaton for each group of items with about ``max_words`` words; one group at a time is collected."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
                             F.col("text").cast("binary").alias("body"))
    # A word and the gap after it take two bytes or more.
    groups = max(1, -(-(items.agg(F.sum(F.length("body"))).first()[0] or 0) // (2 * max_words)))
    out = []
    for k in range(groups):
        rows = items.filter(F.pmod(F.xxhash64("name", "body"), F.lit(groups)) == k).collect()
        automaton = Automaton([(r["name"], item_words(r["body"])) for r in rows], window)
        if automaton.shortest:
            out.append(spark.sparkContext.broadcast(automaton))
    return out


def _searched(automata: list, text: bytes) -> tuple[np.ndarray, list[str]]:
    words = text.translate(PLAIN_WORDS).split()
    hit, found = np.zeros(len(words), dtype=bool), set()
    for automaton in automata:
        found |= automaton.value.search(words, hit)
    return hit, sorted(found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit`` and ``item_ids``, the items found, sorted as strings."""
    automata = build_automata(benchmark, window)
    key = docs.schema[doc_id].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            counts, hits, items = [], [], []
            for i in range(len(texts)):
                hit, found = _searched(automata, texts.text(i))
                counts.append(len(hit))
                hits.append(int(hit.sum()))
                items.append(found)
            yield pa.record_batch([texts.rows.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                                   pa.array(items, pa.list_(pa.string()))],
                                  names=["doc_id", "n_words", "n_hit", "item_ids"])

    schema = T.StructType([T.StructField("doc_id", key), T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType()),
                           T.StructField("item_ids", T.ArrayType(T.StringType()))])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return binary_text(rows).mapInArrow(search, schema)


def cut_hits(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and the gaps between neighbouring ones."""
    spans = [m.span() for m in WORD.finditer(text.translate(LOWER_BYTES))]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    kept, at = [], 0
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        kept.append(text[at:spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*kept, text[at:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8,
                 text: str = "text") -> DataFrame:
    """The documents, all columns as they were, with hit spans cut out of the text.

    A document of whose words more than ``max_coverage`` is hit goes. Texts without a hit stay byte for byte.
    """
    automata = build_automata(benchmark, window)
    at = docs.columns.index(text)
    # Tasks take columns by name, and a name may have a dot; so they go under numbers.
    plain, body_name = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{at}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches, body_name):
            keep, changed, bodies = [], False, []
            nulls = texts.rows.column(at).is_null().to_pylist()
            for i in range(len(texts)):
                body = None if nulls[i] else texts.text(i)
                hit, _ = _searched(automata, body or b"")
                keep.append(not len(hit) or hit.mean() <= max_coverage)
                if hit.any():
                    body, changed = cut_hits(body, hit), True
                bodies.append(body)
            out = texts.rows
            if changed:
                out = out.set_column(at, out.schema.field(at), pa.array(bodies, out.column(at).type))
            yield out.filter(pa.array(keep))

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == body_name else f.dataType) for f in plain.schema])
    cleaned = binary_text(plain, body_name).mapInArrow(clean, schema)
    return cleaned.withColumn(body_name, F.col(body_name).cast("string")).toDF(*docs.columns)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
