"""Counters and latency figures from event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.order_stats import index_percentiles

PERCENTILES = (0.5, 0.95, 0.99)


def llm_metrics(events: DataFrame) -> DataFrame:
    """Calls, tokens, latency and errors per operation, and over all (operation null)."""
    return (events.rollup("operation")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens"),
                 F.sum("latency_ms").alias("latency_ms"), F.count_if(F.col("status") == "error").alias("errors")))


def sql_metrics(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_executions"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_latency_ms"),
        F.coalesce(F.sum("rows_returned"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "timeout").alias("timeouts"))


def retrieval_metrics(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_searches"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_latency_ms"),
        F.coalesce(F.sum("results_count"), F.lit(0)).cast("bigint").alias("total_results"))


def request_metrics(events: DataFrame, by: Sequence[str] = (), latency: str = "latency_ms") -> DataFrame:
    """Count, mean and the 50th, 95th and 99th percentile by sorted position; zeros when empty."""
    by = list(by)
    totals = events.groupBy(*by).agg(F.count(latency).alias("count"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_ms"))
    at = index_percentiles(events, by, latency, PERCENTILES)
    wide = at.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(p * 100)}_ms")
                                 for p in PERCENTILES])
    names = [f"p{round(p * 100)}_ms" for p in PERCENTILES]
    if by:
        return totals.join(wide, by, "left").fillna(0.0, names)
    # Both sides are single rows; scalar subqueries put them side by side.
    return totals.select("*", *[F.coalesce(wide.select(n).scalar(), F.lit(0.0)).alias(n) for n in names])


def metrics_summary(llm: DataFrame, sql: DataFrame, retrieval: DataFrame, requests: DataFrame) -> DataFrame:
    """Every total in long form: (area, metric, value)."""
    def long(area: str, df: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.lit(area).alias("area"), F.explode(cells).alias("c")).select("area", "c.*")

    calls = llm.agg(F.count(F.lit(1)).alias("total_calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
                    F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_latency_ms"),
                    F.count_if(F.col("status") == "error").alias("errors"))
    return (long("llm", calls).unionByName(long("sql", sql_metrics(sql)))
            .unionByName(long("retrieval", retrieval_metrics(retrieval)))
            .unionByName(long("requests", request_metrics(requests))))
