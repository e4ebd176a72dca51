"""op12: whitened components of every embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.registry import query, table
from ledgerlight.llm.whitening import whiten


@query("op12_embedding_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whiten(table(spark, folder, "embeddings"), F.col("embedding"), {"vec_id": F.col("vec_id")})
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return rows.select("row.vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained",
        "identity_error")
