"""op10: which documents are kept as samples of good text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm.registry import query, table
from ledgerlight.llm.resampling import resample


@query("op10_quality_classifier")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = resample(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "log_weight", "key", "kept")
