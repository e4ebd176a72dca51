"""Near copies across a whole corpus, by Jaccard similarity of word sets.

Exact copies fold into one set first. The rest meet as in the n-gram join (:mod:`ledgerlight.llm.jaccard`), with words
for shingles: small sets by their subsets of the size two similar ones share, larger ones by parts, one more of them than
two similar sets can differ in, so that some part is the same in both. Lists of sets with an equal part hold hardly
anything but near copies even where every word is common, as the words of a growing corpus become, and a set has as many
entries as it has parts however large the corpus is. Pairs that meet are checked on their words, and of a large group
only as many as join it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text as tx
from ledgerlight.functions.binding import bind
from ledgerlight.session import cut_lineage, spread

THRESHOLD = 0.9


def _similar(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def word_sets(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, words, n, signature) of texts with words; equal sets have equal signatures.

    They are written once, with the empty ones: a filter in the same plan would cut every text anew.
    """
    made = spread(df.select(F.col(id_).alias("id"), F.col(text).alias("text"))).select("id", bind(F.sort_array(tx.word_set("text")), lambda w: F.struct(
        w.alias("words"), F.size(w).alias("n"), F.sha2(F.array_join(w, " "), 256).alias("signature"))).alias("s"))
    return cut_lineage(made.select("id", "s.*")).where("n > 0")


def connected_groups(edges: DataFrame) -> DataFrame:
    """(id, group_id) of every id with an edge, the group being its lowest id.

    Alternates hooking every neighbour onto the lowest one above and below, which halves
    chains instead of walking them. Per id only a minimum is taken, so a busy id is
    aggregated in parts.
    """
    current = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        upward = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("_m").alias("a"), "b").distinct()
        down = upward.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("_m"))
        hooked = down.join(least, "u")
        step = cut_lineage(hooked.select(F.col("_m").alias("a"), F.col("v").alias("b"))
                           .unionByName(least.select(F.col("_m").alias("a"), F.col("u").alias("b")))
                           .where(F.col("a") != F.col("b")).distinct())
        # Edges only ever move to lower ids, so a round that moves none leaves their number and sum as they were.
        sums = step.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in (1, 2)]).first()
        if sums == before:
            break
        current, before = step, sums
    members = step.select(F.col("b").alias("id"), F.col("a").alias("group_id"))
    return members.unionByName(step.select(F.col("a").alias("id"), F.col("a").alias("group_id")).distinct())


def near_copies(df: DataFrame, id_: str, text: str, threshold: float = THRESHOLD, **tuning: int) -> DataFrame:
    """(id, group_id, similarity) of every row: the lowest id of its group, and how similar the two texts are.

    One row per text however large a group is. Groups are joined by links of ``threshold`` or
    more, so a text may be less similar to its group's lowest one. Null for texts without words.
    """
    sets = word_sets(df, id_, text)
    groups = cut_lineage(_grouped(sets, threshold, **tuning))
    # Words are compared only where a text is no exact copy of its group's lowest one.
    lowest = groups.join(sets.select(F.col("id").alias("group_id"), F.col("signature").alias("_own")), "group_id")
    unlike = lowest.where("signature <> _own").select("signature", "group_id").distinct()
    words = sets.groupBy("signature").agg(F.first("words").alias("words"))
    both = unlike.join(words.withColumnRenamed("words", "_w"), "signature").join(
        sets.select(F.col("id").alias("group_id"), F.col("words").alias("_g")), "group_id")
    shared = F.size(F.array_intersect("_w", "_g"))
    measured = both.select("signature", "group_id", _similar(shared, F.size("_w"), F.size("_g")).alias("_s"))
    similar = lowest.join(measured, ["signature", "group_id"], "left").select("id", "group_id", F.coalesce("_s", F.lit(1.0)).alias("similarity"))
    return (df.select(F.col(id_).alias("id")).join(similar, "id", "left")
            .select(F.col("id").alias(id_), F.coalesce("group_id", "id").alias("group_id"), "similarity"))


def similar_groups(sets: DataFrame, threshold: float = THRESHOLD, small: int | None = None, rounds: int | None = None) -> DataFrame:
    """(id, group_id) of every id: the lowest id that links of ``threshold`` or more lead to.

    ``sets`` has id and words. Lists longer than ``small`` are compared in blocks of that size. ``rounds`` has no effect;
    callers of an earlier form, which thinned buckets in rounds, may still give it.
    """
    from ledgerlight.llm.jaccard import LIST_BLOCK, near_groups  # the subpackage may be left out

    rule = Fraction(threshold).limit_denominator(10_000)
    texts = cut_lineage(sets.select(F.col("id").alias("doc_id"), F.array_join("words", " ").alias("text")))
    near = near_groups(texts, 1, rule.numerator, rule.denominator, LIST_BLOCK if small is None else small)
    # An id that has several sets joins their groups.
    return connected_groups(near.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))


def _grouped(sets: DataFrame, threshold: float, **tuning: int) -> DataFrame:
    """(id, signature, group_id) of every text with words."""
    first = cut_lineage(sets.groupBy("signature").agg(F.min("id").alias("first_id")))
    distinct = sets.join(first.select(F.col("first_id").alias("id")), "id", "left_semi").select("id", "words")
    groups = similar_groups(distinct, threshold, **tuning)
    folded = first.join(groups.withColumnRenamed("id", "first_id"), "first_id", "left") \
        .select("signature", F.coalesce("group_id", "first_id").alias("group_id"))
    return sets.select("id", "signature").join(folded, "signature")


def dedup_corpus(df: DataFrame, id_: str, text: str, threshold: float = THRESHOLD, **tuning: int) -> DataFrame:
    """(id, group_id) for every row; the rows to keep are those whose group_id is their own.

    Texts without words are nobody's copy.
    """
    grouped = _grouped(word_sets(df, id_, text), threshold, **tuning).select("id", "group_id")
    return (df.select(F.col(id_).alias("id")).join(grouped, "id", "left")
            .select(F.col("id").alias(id_), F.coalesce("group_id", "id").alias("group_id")))
