"""Near copies by fingerprint: 64 bits that differ in few places where texts differ in few shingles.

Fingerprints that differ in at most d bits are found by deletion variants. The bits are cut into d // 2 + 1 segments,
so few that one of them differs by at most one bit. Every segment is indexed as it is and once with each of its bits
left out; two fingerprints meet in the bucket of the equal segment, or of the variant without the bit they differ in,
where they come from opposite sides. Buckets are joined by equality and pairs verified on all bits.

Only fingerprints are indexed, each once however many documents have it. Of a bucket that many share, first the least
and the greatest member are compared, then all with the least, one comparison each; what these links leave apart is
joined in small buckets. Large ones are cut again by the bits outside their segment, which still differ by at most d, so
the same rule splits them without losing a pair, until as few bits are open as a small bucket could have members for.

Defined for awkward rows: a null or empty text has fingerprint zero and is linked like any other; equal texts have equal
fingerprints; a group of documents without any id has no component; an empty table gives no rows; a text may be as long
as Arrow allows, its hashes take eight bytes a word. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.batches import LOWER, binary_text, slices, words
from ledgerlight.llm.components import connected
from ledgerlight.session import cut_lineage, sized

BITS = 64
SEED = 42
SMALL_BUCKET = 64  # members up to which a bucket's pairs are joined
FEW_BITS = 8  # open bits below which a bucket is joined whatever it holds: at most 2 ** 8 fingerprints a side
_LANES = np.uint64(0x0101010101010101)  # the lowest bit of each byte


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, by run: runs start at ``starts``, which are distinct and ascend from 0 on.

    Eight bits are counted at once in the bytes of a word, over stretches short enough for a byte.
    """
    ends = np.append(starts[1:], len(hashes))
    pieces = -(-(ends - starts) // 255)
    owner = np.repeat(np.arange(len(starts)), pieces)
    first = np.cumsum(pieces) - pieces
    cuts = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    out = np.empty((len(starts), 8, 8), dtype=np.int64)  # run, byte, bit of the byte
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        out[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(-1, BITS)


def fingerprint_runs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``counts`` hashes: a bit is set where more than half the hashes have it."""
    out, filled = np.zeros(len(counts), dtype=np.uint64), np.flatnonzero(counts)
    if len(filled):
        starts = (np.cumsum(counts) - counts)[filled]
        bits = 2 * bit_counts(hashes, starts) > counts[filled][:, None]
        out[filled] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(words_of: list[bytes], n: int) -> list[int]:
    """XXH64 of every run of n words joined by blanks; of all of them where there are fewer than n."""
    if not words_of:
        return []
    joined, ends = b" ".join(words_of), np.cumsum([len(w) + 1 for w in words_of]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[min(n, len(ends)) - 1:])]


def fingerprints(docs: DataFrame, doc_id: Column, text: Column, n: int = 3) -> DataFrame:
    """``doc_id`` and ``finger``, the fingerprint as a signed 64-bit number, of every document."""
    rows = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            found = words(texts, "space")
            data = LOWER[texts.data].tobytes()
            spelled = [data[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist())]
            hashed = [shingle_hashes(spelled[a:b], n) for a, b in zip(found.before[:-1].tolist(), found.before[1:].tolist())]
            counts = np.array([len(h) for h in hashed], dtype=np.int64)
            flat = np.fromiter((h for one in hashed for h in one), dtype=np.uint64, count=int(counts.sum()))
            yield pa.record_batch([texts.rows.column(texts.rows.schema.get_field_index("doc_id")),
                                   pa.array(fingerprint_runs(flat, counts).view(np.int64))], names=["doc_id", "finger"])

    return binary_text(rows).mapInArrow(work, rows.select("doc_id", F.lit(0).cast("long").alias("finger")).schema)


def signed(bits: int) -> int:
    """The 64 bits as Spark's long."""
    bits &= (1 << BITS) - 1
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def segments(places: list[int], differing: int) -> list[list[int]]:
    """The bit places cut into as many even segments as make one of them differ by at most one bit."""
    count = differing // 2 + 1
    return [places[i * len(places) // count:(i + 1) * len(places) // count] for i in range(count)]


def variants(places: list[int], fixed: int, differing: int) -> list[tuple[int, int, int]]:
    """The bucket kinds of some open places: bits that are fixed, the bit left out (0 for none), bits still open.

    ``fixed`` is what an outer bucket has fixed already.
    """
    out = []
    for segment in segments(places, differing):
        mask = fixed | sum(1 << p for p in segment)
        rest = sum(1 << p for p in places if p not in segment)
        out += [(signed(mask), 0, signed(rest))] + [(signed(mask & ~(1 << p)), signed(1 << p), signed(rest)) for p in segment]
    return out


def _kinds(found: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"),
                              F.lit(r).cast("long").alias("open")) for m, b, r in found])


def _indexed(rows: DataFrame, kinds: Column) -> DataFrame:
    """``mask, bit, open``, the bucket's ``value``, the ``side`` a fingerprint is on, and ``finger``."""
    return rows.select("finger", F.explode(kinds).alias("k")).select(
        "k.mask", "k.bit", "k.open", F.col("finger").bitwiseAND(F.col("k.mask")).alias("value"),
        (F.col("finger").bitwiseAND(F.col("k.bit")) != 0).alias("side"), "finger")


def _near(a: str, b: str, differing: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= differing


def near_links(distinct: DataFrame, differing: int = 3) -> DataFrame:
    """Links ``a``, ``b`` between distinct values of ``finger`` that differ in at most ``differing`` bits.

    Not all such pairs, but enough that the same fingerprints are connected. Every link is a true one.
    """
    return _linked(distinct, differing)[0]


def _linked(distinct: DataFrame, differing: int) -> tuple[DataFrame, DataFrame]:
    """The links, and ``node``, ``root`` of the groups they make. What is connected once is not connected anew."""
    spark = distinct.sparkSession
    key = ["mask", "value"]
    first = variants(list(range(BITS)), 0, differing)
    index, rows = _indexed(distinct, _kinds(first)), distinct.count() * len(first)
    found: list[DataFrame] = []
    open_links: list[tuple[DataFrame, int]] = []  # found, but not in `roots` yet, and how many
    roots = None

    def add(pairs: DataFrame, a: str, b: str, most: int) -> None:
        links = pairs.filter(_near(a, b, differing)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
        found.append(cut_lineage(sized(links, most)))
        open_links.append((found[-1], found[-1].count()))

    def connect() -> DataFrame:
        known = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        most = sum(n for _, n in open_links) + sum(k.count() for k in known)
        out = connected(_union(known + [links for links, _ in open_links]), most=most)
        open_links.clear()
        return out

    while True:
        buckets = cut_lineage(sized(index.groupBy(*key).agg(
            F.min("finger").alias("least"), F.max("finger").alias("most"), F.count("*").alias("n"),
            F.max("bit").alias("bit"), F.min("side").alias("low"), F.max("side").alias("high")), rows).filter(
            "n > 1 and (bit = 0 or low != high)"))
        add(buckets, "least", "most", buckets.count())
        shared = index.join(buckets.filter("n > 2").select(*key, "least", "n"), key)
        members = cut_lineage(sized(shared, rows))
        rows = members.count()
        add(members, "finger", "least", rows)
        roots = connect()
        placed = members.join(roots, members["finger"] == roots["node"], "left").drop("node").withColumn(
            "root", F.coalesce("root", "finger"))
        placed = cut_lineage(sized(placed, rows))
        apart = sized(placed.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high")), rows).filter("low != high")
        left = cut_lineage(sized(placed.join(apart.select(*key), key), rows))
        few = F.bit_count("open") <= FEW_BITS
        light = left.filter((F.col("n") <= SMALL_BUCKET) | few)
        one, other = light.alias("x"), light.alias("y")
        add(one.join(other, (F.col("x.mask") == F.col("y.mask")) & (F.col("x.value") == F.col("y.value"))
                     & (F.col("x.finger") < F.col("y.finger")) & (F.col("x.root") != F.col("y.root"))
                     & ((F.col("x.bit") == 0) | (F.col("x.side") != F.col("y.side"))))
            .select(F.col("x.finger").alias("p"), F.col("y.finger").alias("q")), "p", "q", left.count() * SMALL_BUCKET)
        heavy = left.filter((F.col("n") > SMALL_BUCKET) & ~few).select("mask", "bit", "open", "finger")
        kinds = heavy.groupBy("mask", "bit", "open").count().collect()  # as many as the index has bucket kinds
        if not kinds:
            return _union(found), connect() if open_links[0][1] else roots
        finer = [(k["mask"], inner) for k in kinds
                 for inner in variants([p for p in range(BITS) if k["open"] >> p & 1], k["mask"], differing)]
        cuts = spark.createDataFrame([(outer, *inner) for outer, inner in finer],
                                     "outer long, mask long, bit long, open long")
        inner = sized(heavy.select(F.col("mask").alias("outer"), "finger").distinct(), rows).join(F.broadcast(cuts), "outer")
        most = sum(k["count"] for k in kinds) * (len(finer) // len(kinds) + 1)
        index = cut_lineage(sized(inner.select(
            "mask", "bit", "open", F.col("finger").bitwiseAND(F.col("mask")).alias("value"),
            (F.col("finger").bitwiseAND(F.col("bit")) != 0).alias("side"), "finger").distinct(), most))
        rows = index.count()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def near_fingerprints(docs: DataFrame, n: int = 3, differing: int = 3, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``doc_id``, ``finger`` and ``component``, the least id among documents linked directly or through others.

    Each document has one row. A fingerprint that a third of all documents share is one row of the index; to hand its
    component back, documents meet it by the part of the input they stand in, so no task gets them all.
    """
    column = F.col(f"`{doc_id}`")
    rows = cut_lineage(fingerprints(docs, column, F.col(f"`{text}`"), n).withColumn("part", F.spark_partition_id()))
    most = rows.count()
    classes = cut_lineage(sized(rows.groupBy("finger").agg(F.min("doc_id").alias("first")), most))
    groups = _linked(classes, differing)[1].withColumnRenamed("node", "finger")
    rooted = cut_lineage(sized(classes.join(groups, "finger", "left"), most).withColumn("root", F.coalesce("root", "finger")))
    firsts = sized(rooted.groupBy("root").agg(F.min("first").alias("component")), most)
    placed = cut_lineage(sized(rooted.join(firsts, "root").select("finger", "component"), most))
    by_part = sized(rows.select("finger", "part").distinct(), most).join(placed, "finger")
    return sized(rows.join(by_part, ["finger", "part"]), most).select("doc_id", "finger", "component")
