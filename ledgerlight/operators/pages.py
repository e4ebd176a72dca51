"""Pages by key over a table that lies in order of owner and time, so a page reads the files it stands in and no others.

A page is asked for with a cursor, the time and id of the last row seen, and not with a number of rows to skip. The table
is written in ranges of owner, time and id; beside it an index has a row for each file and owner in it, with the rows the
owner has there and their newest and oldest. A page takes an owner's files from the cursor on until they hold enough rows.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_ROWS = 100_000


class Pages(NamedTuple):
    spark: SparkSession
    path: str
    owner: str
    created: str
    tie: str

    def rows(self, files: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/empty").schema)
        return reader.parquet(*files or [f"{self.path}/empty"])

    def index(self) -> DataFrame:
        """(file, owner, n, newest, oldest)"""
        return self.spark.read.parquet(f"{self.path}/index")


def write_pages(df: DataFrame, path: str, owner: str = "user_id", created: str = "created_at", tie: str = "id",
                file_rows: int = FILE_ROWS) -> Pages:
    """Writes ``df`` in order of owner and time, and its index. An owner with very many rows lies in many files."""
    spark, pages = df.sparkSession, Pages(df.sparkSession, path, owner, created, tie)
    n = df.count()
    ranged = df.repartitionByRange(max(1, -(-n // file_rows)), owner, created, tie).sortWithinPartitions(owner, created, tie)
    ranged.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/empty")
    place = F.struct(F.col(created).alias("created"), F.col(tie).alias("tie"))
    stored = spark.read.schema(df.schema).parquet(f"{path}/rows").select(
        F.col("_metadata.file_path").alias("file"), F.col(owner).alias("owner"), place.alias("place"))
    stored.groupBy("file", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("newest"), F.min("place").alias("oldest")) \
        .sort("owner").write.parquet(f"{path}/index")
    return pages


def page_before(pages: Pages, owner: Any, limit: int = 20, cursor: tuple[Any, Any] | None = None,
                where: Column | None = None) -> DataFrame:
    """The owner's ``limit`` newest rows older than ``cursor`` (time, id), newest first; those without a time come last.

    ``where`` narrows them further. How many rows of a file pass it is not known before, so files are then read twice as
    many at a time until the page is full.
    """
    kinds = {f.name: f.dataType for f in pages.rows().schema}
    index = pages.index().where(F.col("owner") == F.lit(owner))
    place = F.struct(F.col(pages.created).alias("created"), F.col(pages.tie).alias("tie"))
    older: Column | None = None
    if cursor is not None:
        at = F.struct(F.lit(cursor[0]).cast(kinds[pages.created]).alias("created"), F.lit(cursor[1]).cast(kinds[pages.tie]).alias("tie"))
        older = place < at
        # Rows of the file the cursor stands in may be newer than it, so they are not counted on.
        index = index.where(F.col("oldest") < at).withColumn("n", F.when(F.col("newest") < at, F.col("n")).otherwise(0))
    upto = F.sum("n").over(Window.partitionBy("owner").orderBy(F.desc("newest"), "file")) - F.col("n")
    found = index.withColumn("before", upto)  # a row per file of one owner
    if where is None:
        found = found.where(F.col("before") < limit)
    files = [r["file"] for r in found.orderBy(F.desc("newest"), "file").select("file").collect()]

    def page(some: list[str]) -> DataFrame:
        rows = pages.rows(some).where(F.col(pages.owner) == F.lit(owner))
        for condition in (older, where):
            rows = rows if condition is None else rows.where(condition)
        return rows.orderBy(F.desc(pages.created), F.desc(pages.tie)).limit(limit)

    if where is None:
        return page(files)
    taken = 1
    while taken < len(files) and page(files[:taken]).count() < limit:
        taken *= 2
    return page(files[:taken])
