"""Documents to training text: five operators of the training-text subpackage, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.decontamination import remove_leaks
from ledgerlight.llm.jaccard import one_of_each
from ledgerlight.llm.line_chunks import drop_passages
from ledgerlight.llm.mixing import mix_sources, packed_blocks
from ledgerlight.llm.resampling import keep_like_target
from ledgerlight.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents unlike those labelled good go."""
    return keep_like_target(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two or more lines that stand earlier in the corpus go from the text."""
    cleaned = drop_passages(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(
        F.col("row")["n_chars"])}
    return cleaned.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return one_of_each(docs, 5, 80, 100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go from the text; documents that are little else go."""
    cleaned = remove_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def traced_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: blocks of words by output shard, with the documents of each in ``doc_ids``."""
    return packed_blocks(docs, mix_sources(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix without ``doc_ids``."""
    return traced_mix(spark, docs, sf_dir).drop("doc_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mix),
]
#: The classifier and the shuffle of the mix have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. The mix that comes out tells which documents its rows are made of."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return traced_mix(spark, docs, sf_dir)
