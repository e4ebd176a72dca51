"""Revenue, trend and margin questions over fact and dimension tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between_dates(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Rows with ``low <= column < high``.

    The bounds are literals of the column's own type, so no cast wraps the column and the
    filter reaches the Parquet scan.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    return df.where((c >= F.lit(low).cast(kind)) & (c < F.lit(high).cast(kind)))


def period_total(df: DataFrame, column: str, low: str, high: str, amount: str, name: str = "total") -> DataFrame:
    return between_dates(df, column, low, high).agg(F.round(F.sum(amount), 2).alias(name))


def monthly_trend(df: DataFrame, date: str, amount: str, name: str = "revenue") -> DataFrame:
    month = F.date_trunc("month", F.col(date)).cast("date")
    return (df.groupBy(month.alias("month"))
            .agg(F.round(F.sum(amount), 2).alias(name))
            .orderBy("month"))


def active_customers(df: DataFrame, date: str, customer: str, days: int = 90, approx: bool = False) -> DataFrame:
    """Distinct customers in the ``days`` up to the newest date of the table.

    Anchored on the data instead of today, so a rerun answers the same. The anchor is one
    value from a min/max scan and turns the filter into a literal the scan can push down.
    """
    anchor = df.agg(F.max(date).alias("d")).first()["d"]
    if anchor is None:
        recent = df.where(F.lit(False))
    else:
        low = anchor - dt.timedelta(days=days)
        recent = df.where(F.col(date) >= F.lit(str(low)).cast(df.schema[date].dataType))
    count = F.approx_count_distinct(customer) if approx else F.count_distinct(customer)
    return recent.agg(count.alias("active_customers"))


def cost_per_distinct(df: DataFrame, group: str, cost: str, customer: str, name: str = "cac") -> DataFrame:
    """Sum of cost over distinct customers per group.

    Reduced to one row per (group, customer) first, so a hot group is spread over its
    customers before the final small aggregate.
    """
    per_customer = df.groupBy(group, customer).agg(F.sum(cost).alias("_cost"))
    return per_customer.groupBy(group).agg(
        F.round(F.sum("_cost") / F.count(customer), 4).alias(name))


def actual_vs_budget(df: DataFrame, date: str, actual: Column, budget: Column) -> DataFrame:
    month = F.date_trunc("month", F.col(date)).cast("date")
    return (df.groupBy(month.alias("month"))
            .agg(F.round(F.sum(actual), 2).alias("actual"), F.round(F.sum(budget), 2).alias("budget"))
            .orderBy("month"))


def gross_margin(df: DataFrame, revenue: Column, cogs: Column, by: list[Column] | None = None) -> DataFrame:
    """(revenue - cogs) / revenue * 100; null where revenue is zero."""
    rev, cost = F.sum(revenue), F.sum(cogs)
    pct = F.when(rev != 0, F.round((rev - cost) / rev * 100, 4))
    return df.groupBy(*(by or [])).agg(pct.alias("gross_margin_pct"))


def top_product(fact: DataFrame, product: DataFrame, fact_key: str, product_key: str,
                label: str, amount: Column) -> DataFrame:
    """The label with the highest total.

    The fact table is summed per key before the join, so the join moves one row per key
    instead of one per sale, and a hot product is already one row.
    """
    per_key = fact.groupBy(fact_key).agg(F.sum(amount).alias("_amount"))
    return (per_key.join(product.select(product_key, label), F.col(fact_key) == F.col(product_key))
            .groupBy(label).agg(F.round(F.sum("_amount"), 2).alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), label).limit(1))


def average_by_dimension(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                         attribute: str, amount: str, name: str) -> DataFrame:
    """Average of ``amount`` by an attribute of the joined table.

    Sum and count per join key come first: a customer holding a third of all orders is one
    row by the time the join shuffles.
    """
    per_key = fact.groupBy(fact_key).agg(F.sum(amount).alias("_sum"), F.count(amount).alias("_n"))
    return (per_key.join(dim.select(dim_key, attribute), F.col(fact_key) == F.col(dim_key))
            .groupBy(attribute)
            .agg(F.round(F.sum("_sum") / F.sum("_n"), 4).alias(name)))
