"""Arrow batches of texts as numpy arrays: bytes, words and n-gram hashes without a Python object per word.

All functions treat a null text as an empty one. Hashes are 64 bits wide and depend only on the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 32  # bytes; longer words are hashed one by one
SLICE_BYTES = 1 << 19  # text worked on at once in a task; a longer text is a slice of its own

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: Bytes of the words of each kind. ``space``: all but blank, tab to carriage return. ``plain``: digits, letters and
#: whatever is not ASCII. Both work on UTF-8 bytes, whose parts above 0x7F always belong to a word.
WORD_BYTES = {
    "space": _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D),
    "plain": _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80),
}
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
LOWER_BYTES = LOWER.tobytes()
#: For bytes.translate: lower case, and a blank for all that is not part of a plain word.
PLAIN_WORDS = bytes(LOWER[b] if WORD_BYTES["plain"][b] else 0x20 for b in range(256))


class Texts(NamedTuple):
    """Some rows of a batch: their bytes end to end, where each text starts, and the rows themselves."""

    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, one more than rows
    rows: pa.RecordBatch

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i + 1]].tobytes()


class Words(NamedTuple):
    """Words of a slice: where each starts and ends, and the number of words before each text."""

    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray  # int64, one more than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.before)


def binary_text(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with the text as UTF-8 bytes, which tasks need not decode."""
    return df.withColumn(text, F.col(text).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cuts batches into runs of rows with about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
        _, where, what = column.buffers()
        ends = np.frombuffer(where, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, np.uint8)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            last = min(last, batch.num_rows)
            yield Texts(data[ends[first]:ends[last]], ends[first:last + 1] - ends[first],
                        batch.slice(first, last - first))
            first = last


def words(texts: Texts, kind: str) -> Words:
    """Words of each text; none reaches over the end of its text."""
    inside = WORD_BYTES[kind][texts.data]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[texts.starts] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(inside) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.starts))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: every bit of the input moves half the bits of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64; kept for the next slice of the task."""
    if len(_POWERS.get(base, ())) <= n:
        out = np.full(max(n, SLICE_BYTES) + 1, base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n + 1]


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once. Sorts, which for 64-bit values is many times faster than np.unique."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, from running sums: the length of a span does not matter.

    Long data is gone through in parts, so that the sums take little memory.
    """
    if len(data) > 2 * SLICE_BYTES and len(starts):
        out, order, done = np.empty(len(starts), dtype=np.uint64), np.argsort(starts, kind="stable"), 0
        while done < len(order):
            low = starts[order[done]]
            upto = done + int(np.searchsorted(starts[order[done:]], low + SLICE_BYTES))
            mine = order[done:upto]
            high = ends[mine].max()
            if high - low > 2 * SLICE_BYTES:  # a span as long as that is summed by itself
                high, mine, upto = ends[order[done]], order[done:done + 1], done + 1
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[data[low:high]] * powers(int(high - low))[:-1], out=sums[1:])
            own = (sums[ends[mine] - low] - sums[starts[mine] - low]) * powers(int(high - low), _INVERSE)[starts[mine] - low]
            out[mine] = mix(own + (ends[mine] - starts[mine]).astype(np.uint64) * np.uint64(_BASE))
            done = upto
        return out
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data))[:-1], out=sums[1:])
    # A sum from `start` on carries base ** start; the inverse takes it off, so equal bytes hash alike anywhere.
    own = (sums[ends] - sums[starts]) * powers(len(data), _INVERSE)[starts]
    return mix(own + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def span_sums(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes that start at each place."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data))[:-1], out=sums[1:])
    count = max(len(data) - length + 1, 0)
    return mix((sums[length:length + count] - sums[:count]) * powers(len(data), _INVERSE)[:count])


def word_hashes(texts: Texts, kind: str, lower: bool = True) -> tuple[Words, np.ndarray]:
    """Words and the hash of each. Sums modulo a power of two are equal for some long strings, so those have a digest."""
    found = words(texts, kind)
    data = LOWER[texts.data] if lower else texts.data
    hashes = span_hashes(data, found.starts, found.ends)
    for i in np.flatnonzero(found.ends - found.starts > LONG_WORD):
        digest = hashlib.blake2b(data[found.starts[i]:found.ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return found, hashes


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word; shorter than the input by n - 1."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[k:k + count]
    return mix(out + np.uint64(n))


def within(before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose n words lie in one text, and the text of each."""
    counts = np.maximum(np.diff(before) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[owner] + before[:-1][owner], owner
