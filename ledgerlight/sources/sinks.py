"""Where results are written, and the labelled question set they are judged by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

QUESTIONS = ("id string, question string, intent string, expected_sql string, relevant_doc_ids array<string>")
FILE_ROWS = 1_000_000
CSV_PREFACE = "# SQL Results"


def read_questions(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of labelled questions; fields an item lacks are null or empty.

    An array is read by one task a file; with ``lines`` a file has an object per line and is split among tasks.
    """
    df = spark.read.schema(QUESTIONS).option("multiLine", not lines).json(path)
    df = df.withColumn("relevant_doc_ids", F.coalesce("relevant_doc_ids", F.array().cast("array<string>")))
    return df if not limit else df.limit(limit)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk store as Parquet, one folder per source, so a source filter reads only its own.

    Rows are rebalanced by source while they are written: sizes are known from the shuffle, small sources share a task, and
    one that holds most chunks is written by many.
    """
    spread = chunks.hint("rebalance", "source")
    spread.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("source").parquet(path)


def write_csv(df: DataFrame, path: str, preface: bool = True, mode: str = "overwrite") -> bool:
    """CSV with a header in every part; a preface file beside them when there are rows.

    Returns whether rows were written.
    """
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("header", True).csv(path)
    rows = seen.get["rows"] > 0
    if rows and preface:
        spark = df.sparkSession
        spark.createDataFrame([(CSV_PREFACE,)], "value string").coalesce(1).write.mode(mode).text(f"{path}_preface")
    return rows


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per result, nested measures kept nested."""
    df.write.mode(mode).json(path)
