"""op6: documents without strings of fifty bytes that an earlier document has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm.registry import query, table
from ledgerlight.llm.suffix_dedup import remove_repeats


@query("op6_suffix_array_dedup")
def suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))
