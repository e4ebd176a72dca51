"""Positions of rows within ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its group from 0 on, and ``n``, the rows of the group.

    Rows are dealt by ranges of group and order, so a group with a third of all rows lies in many partitions; a row's
    place is its place in its partition plus the rows of the group in earlier partitions, of which there is one number
    per partition. Rows equal in ``order`` (nulls first) are parted by where they were read, so no run of equal rows is
    one task's either; which of them comes first is open. ``group`` must not be null. The rows are written on the way.
    """
    keys = [group, *order, "_tie"]
    ranged = (rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
              .sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    placed = cut_lineage(ranged.withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    offsets = cut_lineage(parts.withColumn("n", F.sum("_rows").over(whole)).withColumn(
        "_before", F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).drop("_rows"))
    return placed.join(offsets, [group, "_part"]).withColumn(
        "pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")
