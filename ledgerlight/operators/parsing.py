"""Typed rows from a model's JSON text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def parse_structured(df: DataFrame, text: str, schema: T.StructType, rules: Mapping[str, Column] | None = None,
                     required: tuple[str, ...] = (), fallback: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``parsed`` and ``parse_error``.

    ``rules`` maps an error text to a condition over ``parsed.*`` columns that must hold; the
    first broken one is reported. Where parsing fails and a fallback is given, ``parsed``
    holds the fallback's fields.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = F.from_json(text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = df.withColumn("parsed", raw)
    error = F.when(F.col(text).isNull() | F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull(), F.lit("invalid JSON"))
    for name in required:
        error = error.when(F.col(f"parsed.{name}").isNull(), F.lit(f"missing field: {name}"))
    for message, holds in (rules or {}).items():
        error = error.when(~F.coalesce(holds, F.lit(True)), F.lit(message))
    out = out.withColumn("parse_error", error)
    good = F.struct(*[F.col(f"parsed.{f.name}").alias(f.name) for f in schema.fields])
    if fallback is None:
        return out.withColumn("parsed", F.when(F.col("parse_error").isNull(), good))
    spare = F.struct(*[fallback.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out.withColumn("parsed", F.when(F.col("parse_error").isNull(), good).otherwise(spare))
