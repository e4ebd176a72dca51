"""Sources, guarded SQL, joins and revenue aggregates over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import guard, relational
from ledgerlight.plans.registry import query
from ledgerlight.sources import catalog

AOV_SQL = """SELECT c.c_mktsegment AS customer_segment, ROUND(AVG(o.o_totalprice), 4) AS avg_order_value
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment"""


@query("src1_table_scan", "\nUNION ALL ".join(
    f"SELECT CAST('{name}' AS VARCHAR) AS table_name, COUNT(*) AS row_count FROM {name}" for name in catalog.TABLES))
def table_scan(t):
    return catalog.row_counts(catalog.register(t.spark, t.folder, catalog.TABLES))


@query("src5_sample_rows", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3
""")
def sample(t):
    cols = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return catalog.sample_rows(t.orders.select(*cols), ["o_orderkey"], 3)


@query("flt1_guarded_query", AOV_SQL)
def guarded(t):
    sources = {name: f"{t.folder}/{name}.parquet" for name in ("orders", "customer")}
    return guard.run_guarded(t.spark, f"```sql\n{AOV_SQL};\n```", sources).rows


@query("flt2_row_cap", """
SELECT o.o_orderkey, o.o_totalprice, (SELECT COUNT(*) FROM orders) AS row_count
FROM orders o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1000
""")
def row_cap(t):
    rows, count = guard.capped(t.orders.select("o_orderkey", "o_totalprice"),
                               [F.desc("o_totalprice"), F.asc("o_orderkey")])
    # The count is one row by construction; it rides along as a scalar subquery.
    return rows.withColumn("row_count", count.scalar())


@query("flt3_cost_gate", """
SELECT 'within the limit' AS query_name, 'success' AS status, COUNT(*) AS row_count FROM orders
UNION ALL SELECT 'over the limit', 'blocked', NULL
""")
def cost_gated(t):
    """One query within its limit, which runs, and the same query with a limit below the size of its table."""
    sources, out = {"orders": f"{t.folder}/orders.parquet"}, []
    for name, limit in (("within the limit", guard.MAX_QUERY_BYTES), ("over the limit", 1)):
        try:
            result = guard.run_guarded(t.spark, "SELECT o_orderkey FROM orders", sources, max_bytes=limit)
            out.append((name, "success", result.row_count))
        except guard.GuardError as refused:
            if refused.rule != "cost":
                raise
            out.append((name, "blocked", None))
    return t.spark.createDataFrame(out, "query_name string, status string, row_count long")


@query("flt4_strip_fences", r"""
SELECT conv_id, turn, trim(text, E' \n\t\r') AS sql_text FROM conversations
""")
def fences(t):
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```sql\n"), "text", F.lit("\n```"))) \
        .when(F.col("turn") % 3 == 1, F.concat(F.lit(" ```\n"), "text", F.lit("```  "))) \
        .otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", guard.strip_fences(fenced).alias("sql_text"))


@query("flt5_identifier_check", r"""
SELECT name, ok, COUNT(*) AS n FROM (
  SELECT name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AS ok FROM (
    SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT replace(p_name, ' ', '_') FROM part))
GROUP BY name, ok
""")
def identifiers(t):
    names = (t.part.select(F.explode(F.array("p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))))
                           .alias("name")))
    return (names.select("name", guard.check_identifier("name").alias("ok"))
            .groupBy("name", "ok").agg(F.count(F.lit(1)).alias("n")))


@query("flt6_between_dates", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate < TIMESTAMP '2000-10-01'
""")
def date_range(t):
    return relational.between_dates(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"),
                                    "o_orderdate", "2000-07-01", "2000-10-01")


@query("ag1_period_total", """
SELECT ROUND(SUM(o_totalprice), 2) AS total_revenue FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate < TIMESTAMP '2000-10-01'
""")
def quarter_revenue(t):
    return relational.period_total(t.orders, "o_orderdate", "2000-07-01", "2000-10-01",
                                   "o_totalprice", "total_revenue")


@query("ag2_monthly_trend", """
WITH monthly_revenue AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, SUM(o_totalprice) AS total
  FROM orders GROUP BY 1)
SELECT month, ROUND(total, 2) AS revenue FROM monthly_revenue ORDER BY month
""")
def trend(t):
    return relational.monthly_trend(t.orders, "o_orderdate", "o_totalprice")


@query("ag3_active_customers", """
SELECT COUNT(DISTINCT o_custkey) AS active_customers FROM orders
WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 90 DAYS
""")
def active(t):
    return relational.active_customers(t.orders, "o_orderdate", "o_custkey")


@query("ag4_cost_per_distinct", """
SELECT event_type AS channel, ROUND(SUM(value) / COUNT(DISTINCT user_id), 4) AS cac
FROM events GROUP BY event_type
""")
def acquisition_cost(t):
    return relational.cost_per_distinct(t.events, "event_type", "value", "user_id") \
        .withColumnRenamed("event_type", "channel")


@query("ag5_actual_vs_budget", """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS actual, ROUND(SUM(l_extendedprice), 2) AS budget
FROM lineitem GROUP BY 1 ORDER BY 1
""")
def actual_budget(t):
    return relational.actual_vs_budget(t.lineitem, "l_shipdate",
                                       F.col("l_extendedprice") * (1 - F.col("l_discount")),
                                       F.col("l_extendedprice"))


@query("ag6_gross_margin", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
       ROUND((SUM(l_extendedprice * (1 - l_discount)) - SUM(l_quantity * p_retailprice))
             / SUM(l_extendedprice * (1 - l_discount)) * 100, 4) AS gross_margin_pct
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def margin(t):
    # Quantity and revenue per (part, year) before the price is joined on.
    year = F.year("l_shipdate").alias("year")
    sold = (t.lineitem.groupBy("l_partkey", year)
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                 F.sum("l_quantity").alias("quantity")))
    priced = sold.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return relational.gross_margin(priced, F.col("revenue"), F.col("quantity") * F.col("p_retailprice"),
                                   [F.col("year")])


@query("jn1_top_product", """
SELECT p_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS total_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY total_revenue DESC, p_name LIMIT 1
""")
def top_product(t):
    return relational.top_product(t.lineitem, t.part, "l_partkey", "p_partkey", "p_name",
                                  F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("jn2_average_order_value", """
SELECT c_mktsegment AS customer_segment, ROUND(AVG(o_totalprice), 4) AS avg_order_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def order_value(t):
    return relational.average_by_dimension(t.orders, t.customer, "o_custkey", "c_custkey", "c_mktsegment",
                                           "o_totalprice", "avg_order_value") \
        .withColumnRenamed("c_mktsegment", "customer_segment")
