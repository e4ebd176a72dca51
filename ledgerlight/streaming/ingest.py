"""Documents to chunks as files arrive, every content once.

A ledger of content hashes tells what has been seen. Each batch of files has a folder of its own in the ledger, the chunks
and the rejects; a replay of a batch reads the ledger without its own entries and replaces its folders, so a failure in
between leaves nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.operators import documents as docs
from ledgerlight.session import cut_lineage

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Files of one batch, by their size together.
BATCH_BYTES = 256 << 20
LEDGER = "path string, filename string, content_hash string, status string"


class Ingest(NamedTuple):
    """What an ingest has written so far under ``path``."""

    spark: SparkSession
    path: str

    def ledger(self) -> DataFrame:
        """A row per file that arrived, with its ``status`` as :func:`judge_files` gives it."""
        return self.spark.read.schema(f"{LEDGER}, batch int").parquet(f"{self.path}/ledger")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rejects")


def judge_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``status`` to files of ``path``, ``filename``, ``content_hash``, ``arrived`` and ``reason``.

    ``rejected`` with a reason; ``repeated`` when the content has been taken before, from the ledger ``seen`` or from an
    earlier file of the batch; ``changed`` when the name has been taken with another content; else ``new``.
    """
    taken = seen.where("status IN ('new', 'changed')")
    hashes = taken.select("content_hash").distinct().withColumn("_known", F.lit(True))
    names = taken.select("filename").distinct().withColumn("_named", F.lit(True))
    fine = files.where("reason IS NULL")
    # Rows here are files of one batch without their content; a batch has a bounded size.
    order = [F.col("arrived"), F.col("path")]
    rows = (fine.join(hashes, "content_hash", "left")
            .withColumn("_again", F.row_number().over(Window.partitionBy("content_hash").orderBy(*order)) > 1))
    repeated = F.col("_known").isNotNull() | F.col("_again")
    fresh = rows.where(~repeated).join(names, "filename", "left").withColumn(
        "_later", F.row_number().over(Window.partitionBy("filename").orderBy(*order)) > 1)
    changed = F.col("_named").isNotNull() | F.col("_later")
    parts = [fresh.withColumn("status", F.when(changed, "changed").otherwise("new")),
             rows.where(repeated).withColumn("status", F.lit("repeated")),
             files.where("reason IS NOT NULL").withColumn("status", F.lit("rejected"))]
    out = [p.select("path", "filename", "content_hash", "status") for p in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, strategy: str = "recursive",
                  provider: Callable[[Column], Column] | None = None, files_per_trigger: int | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Files that arrive under ``folder`` to the ledger, chunks and rejects under ``path``.

    A chunk's document is its content hash, so the same content under two names has one set of chunks. A batch takes
    files of ``BATCH_BYTES``, as each has a price however small its files are, or ``files_per_trigger`` where given.
    """
    size = ("maxBytesPerTrigger", BATCH_BYTES) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    stream = (spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
              .option(*size).load(folder))

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        files = cut_lineage(batch.select(
            "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content", F.col("length").alias("size_bytes"),
            F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("arrived")))
        named, badly_named = docs.admit_documents(files)
        _, unread = docs.admit_documents(docs.decode_text(named), text="text")
        rejects = cut_lineage(badly_named.drop("content").unionByName(unread.drop("content", "text")))
        rows = files.drop("content").join(rejects.select("path", "reason"), "path", "left")
        session.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{path}/ledger/batch=-1")
        seen = ingested(session, path).ledger().where(F.col("batch") < batch_id)
        judged = cut_lineage(judge_files(rows, seen))
        fresh = files.join(judged.where("status IN ('new', 'changed')").select("path"), "path")
        chunks, _ = docs.ingest(fresh.select(F.col("content_hash").alias("document_id"), "filename", "content", "size_bytes"),
                                provider=provider, strategy=strategy)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        rejects.select("path", "filename", "reason").write.mode("overwrite").parquet(f"{path}/rejects/batch={batch_id}")
        # Last: once the ledger has a batch, its chunks and rejects are there.
        judged.write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def ingested(spark: SparkSession, path: str) -> Ingest:
    return Ingest(spark, path)
