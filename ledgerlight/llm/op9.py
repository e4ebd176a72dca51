"""op9: how many words of each document a mix by source weights takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm.mixing import mix_sources, taken_words
from ledgerlight.llm.registry import query, table


@query("op9_mixing_sources")
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, folder, "documents")))
