"""Registered read-only sources: Parquet tables, JDBC tables and their schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Primary and foreign keys of the sample tables; Parquet carries none.
TABLE_KEYS = {
    "region": {"primary": ["r_regionkey"], "foreign": []},
    "nation": {"primary": ["n_nationkey"], "foreign": ["n_regionkey"]},
    "customer": {"primary": ["c_custkey"], "foreign": ["c_nationkey"]},
    "supplier": {"primary": ["s_suppkey"], "foreign": ["s_nationkey"]},
    "part": {"primary": ["p_partkey"], "foreign": []},
    "orders": {"primary": ["o_orderkey"], "foreign": ["o_custkey"]},
    "lineitem": {"primary": [], "foreign": ["l_orderkey", "l_partkey", "l_suppkey"]},
}

SCHEMA_TABLE = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
    T.StructField("default", T.StringType(), True),
    T.StructField("is_primary_key", T.BooleanType(), False),
    T.StructField("is_foreign_key", T.BooleanType(), False),
])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, folder: str, tables: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    """Make each table a temporary view and hand the frames back by name."""
    frames = {name: read_table(spark, folder, name) for name in tables}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return frames


def jdbc_options(config: Mapping[str, object], table: str) -> dict[str, str]:
    """Spark's JDBC options from a data source's stored settings."""
    user = config.get("user") or config.get("username")
    database = config.get("database") or config.get("dbname") or ""
    dialect = config.get("dialect", "postgresql")
    host, port = config.get("host", "localhost"), config.get("port", 5432)
    query = "&".join(f"{k}={v}" for k, v in dict(config.get("query") or {}).items())
    options = {
        "url": f"jdbc:{dialect}://{host}:{port}/{database}" + (f"?{query}" if query else ""),
        "dbtable": table,
    }
    if dialect == "postgresql":
        options["sessionInitStatement"] = "SET default_transaction_read_only = on"
    if user:
        options["user"] = str(user)
    if config.get("password"):
        options["password"] = str(config["password"])
    # A split key turns one connection into parallel range scans.
    for key in ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize"):
        if config.get(key) is not None:
            options[key] = str(config[key])
    return options


def read_jdbc(spark: SparkSession, config: Mapping[str, object], table: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config, table)).load()


def schema_table(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Mapping[str, list[str]]] | None = None,
) -> DataFrame:
    """One row per column of each table, with key flags from ``keys``; reads no data."""
    keys = keys or {}
    rows = []
    for name, frame in tables.items():
        primary = set(keys.get(name, {}).get("primary", ()))
        foreign = set(keys.get(name, {}).get("foreign", ()))
        for ordinal, field in enumerate(frame.schema.fields, start=1):
            default = field.metadata.get("CURRENT_DEFAULT")
            rows.append((name, ordinal, field.name, field.dataType.simpleString(), field.nullable,
                         default, field.name in primary, field.name in foreign))
    return spark.createDataFrame(rows, SCHEMA_TABLE)


def sample_rows(df: DataFrame, order: list[str | Column], n: int = 3) -> DataFrame:
    """The first ``n`` rows in a stated order (a bare LIMIT is not repeatable)."""
    return df.orderBy(*order).limit(n)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One count per table; Parquet answers from its footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
