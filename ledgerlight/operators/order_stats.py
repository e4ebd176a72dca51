"""Exact order statistics without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY
# Up to this many values a group's whole range is its bracket.
SMALL_GROUP = 100_000


def index_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """The value at sorted position ``min(int(n * p), n - 1)`` per group: (keys, p, value).

    A quantile sketch brackets each wanted position with a known error, so only the values
    inside the brackets, under a thousandth of a large group, are counted and ranked; the
    rest are only counted as lying below. A group holding a third of all rows costs three
    scans with partial aggregation and never one big sort.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    low = F.array(*[F.lit(max(0.0, p - MARGIN)) for p in probs])
    high = F.array(*[F.lit(min(1.0, p + MARGIN)) for p in probs])
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", low, ACCURACY).alias("_low"), F.percentile_approx("_v", high, ACCURACY).alias("_high"))
    small = F.col("_n") <= SMALL_GROUP
    brackets = F.array(*[
        F.struct(F.lit(i).alias("i"),
                 F.when(small, F.col("_min")).otherwise(F.col("_low")[i]).alias("lo"),
                 F.when(small, F.col("_max")).otherwise(F.col("_high")[i]).alias("hi"),
                 F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1).alias("at"))
        for i, p in enumerate(probs)])
    targets = stats.select(*keys, F.explode(brackets).alias("b")).select(*keys, "b.*")

    if keys:
        placed = base.join(stats.select(*keys, brackets.alias("_b")), keys)
        bound = F.col("_b")
    else:
        # One row by construction; as literals its bounds reach the scan.
        row = stats.select(brackets.alias("b")).first()
        bound = F.array(*[F.struct(F.lit(b["i"]).alias("i"), F.lit(b["lo"]).alias("lo"), F.lit(b["hi"]).alias("hi"))
                          for b in (row["b"] if row else [])])
        placed = base

    below = placed.groupBy(*keys).agg(*[F.count_if(F.col("_v") < bound[i]["lo"]).alias(f"_below_{i}")
                                        for i in range(len(probs))])
    below = below.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_below_{i}").alias("below"))
                                                    for i in range(len(probs))])).alias("w")).select(*keys, "w.*")
    inside = F.filter(bound, lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    counted = (placed.select(*keys, "_v", F.explode(F.transform(inside, lambda b: b["i"])).alias("i"))
               .groupBy(*keys, "i", "_v").agg(F.count(F.lit(1)).alias("_m")))
    running = F.sum("_m").over(Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = (counted.withColumn("_upto", running)
              .join(below, [*keys, "i"]).join(targets.select(*keys, "i", "at"), [*keys, "i"]))
    offset = F.col("at") - F.col("below")
    picked = ranked.where((F.col("_upto") > offset) & (F.col("_upto") - F.col("_m") <= offset))
    p_of = F.array(*[F.lit(float(p)) for p in probs])
    # A bracket holds its position by the sketch's error bound; if it ever does not, that is an error and no value.
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    wanted = targets.where("at >= 0").select(*keys, "i")  # without values there is no position
    return wanted.join(picked.select(*keys, "i", "_v"), [*keys, "i"], "left").select(
        *keys, F.element_at(p_of, F.col("i") + 1).alias("p"), F.coalesce("_v", missed).alias("value"))


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Median per group of values given with their counts; for few distinct values per group."""
    w = Window.partitionBy(*keys)
    upto = F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(w)
    marked = counts.withColumn("_upto", upto).withColumn("_total", total)

    def holds(position: Column) -> Column:
        return (F.col("_upto") > position) & (F.col("_upto") - F.col(n) <= position)

    lower, upper = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return marked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lower), F.col(value))) + F.max(F.when(holds(upper), F.col(value)))) / 2).alias("median"))
