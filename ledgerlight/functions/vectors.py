"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def mean_vectors(df: DataFrame, group: str, vector: str, name: str) -> DataFrame:
    """The mean vector of each group.

    Averaged per (group, position) with partial sums on the map side; what is gathered per
    group is one number per dimension.
    """
    per_position = (df.select(group, F.posexplode(vector).alias("_pos", "_v"))
                    .groupBy(group, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_mean")))
    gathered = per_position.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_all"))
    return gathered.select(group, F.transform("_all", lambda s: s["_mean"]).alias(name))
