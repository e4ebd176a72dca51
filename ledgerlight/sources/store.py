"""A store of chunks that documents can be replaced in and deleted from, with a snapshot for every change.

Every change writes a folder of its own, split by a hash bucket of the document. A manifest per version names, for every
bucket, the folder that holds it, so a change writes the buckets it touches and a new manifest, and nothing else. Folders
are never changed once written: a reader keeps the snapshot it opened, and every older one can still be read. A manifest is
one file, so a version is there as a whole or not at all; of two writers at once, the second fails and leaves a folder that
no manifest names.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage

BUCKETS = 256


class ChunkStore(NamedTuple):
    spark: SparkSession
    path: str
    document_id: str
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.document_id).cast("string")), F.lit(self.buckets)).cast("int")

    def manifests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def version(self) -> int:
        """The latest version."""
        return self.manifests().agg(F.max("version")).first()[0]

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder that holds each bucket in use; at most ``buckets`` entries."""
        version = self.version() if version is None else version
        rows = self.manifests().where(F.col("version") == version).where("bucket IS NOT NULL").collect()
        return {r["bucket"]: r["folder"] for r in rows}


def create_store(chunks: DataFrame, path: str, document_id: str = "document_id", buckets: int = BUCKETS) -> ChunkStore:
    """A new store under ``path`` whose first version holds ``chunks``, which may be none."""
    spark = chunks.sparkSession
    store = ChunkStore(spark, path, document_id, buckets)
    chunks.limit(0).write.parquet(f"{path}/empty")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(document_id).alias("document_id")).write.parquet(f"{path}/settings")
    _commit(store, 1, chunks, {}, None)
    return store


def open_store(spark: SparkSession, path: str) -> ChunkStore:
    row = spark.read.parquet(f"{path}/settings").first()
    return ChunkStore(spark, path, row["document_id"], row["buckets"])


def _commit(store: ChunkStore, version: int, chunks: DataFrame, held: dict[int, str], touched: set[int] | None) -> None:
    """Writes buckets and then the manifest; ``touched`` buckets are replaced, all of them if None."""
    spark, folder = store.spark, f"{version}-{uuid.uuid4().hex}"
    # Rebalanced by bucket: small buckets share a task, and one that is large is written by several.
    rows = chunks.withColumn("_bucket", store.bucket()).hint("rebalance", "_bucket")
    rows.write.partitionBy("_bucket").parquet(f"{store.path}/data/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{store.path}/data/{folder}")
    filled = {r[0] for r in written.select("_bucket").distinct().collect()}
    kept = {b: f for b, f in held.items() if touched is not None and b not in touched}
    entries = [(b, f) for b, f in {**kept, **dict.fromkeys(filled, folder)}.items()] or [(None, None)]
    manifest = spark.createDataFrame(entries, "bucket int, folder string").coalesce(1)
    manifest.write.mode("error").parquet(f"{store.path}/manifest/version={version}")


def read_store(store: ChunkStore, version: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """All chunks of a version, the latest unless given; of ``documents`` only, whose buckets alone are then read."""
    held = store.folders(version)
    wanted = held if documents is None else {b: held[b] for b in _buckets_of(store, documents) if b in held}
    schema = store.spark.read.parquet(f"{store.path}/empty").schema
    paths = [f"{store.path}/data/{f}/_bucket={b}" for b, f in sorted(wanted.items())]
    rows = store.spark.read.schema(schema).parquet(*paths or [f"{store.path}/empty"])
    if documents is None:
        return rows
    return rows.join(documents.select(store.document_id).distinct(), store.document_id, "left_semi")


def _buckets_of(store: ChunkStore, documents: DataFrame) -> set[int]:
    return {r[0] for r in documents.select(store.bucket().alias("b")).distinct().collect()}


def change_store(store: ChunkStore, chunks: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """Puts ``chunks`` in place of all chunks of their documents and drops the ``removed`` documents; the new version.

    A document in both is replaced. Only the buckets of these documents are read and written.
    """
    version = store.version()
    held = store.folders(version)
    new = None if chunks is None else cut_lineage(chunks.select(*store.spark.read.parquet(f"{store.path}/empty").columns))
    ids = [d.select(store.document_id) for d in (new, removed) if d is not None]
    if not ids:
        return version
    gone = cut_lineage((ids[0] if len(ids) == 1 else ids[0].unionAll(ids[1])).distinct())
    touched = _buckets_of(store, gone)
    schema = store.spark.read.parquet(f"{store.path}/empty").schema
    paths = [f"{store.path}/data/{held[b]}/_bucket={b}" for b in sorted(touched) if b in held]
    before = store.spark.read.schema(schema).parquet(*paths or [f"{store.path}/empty"])
    after = before.join(gone, store.document_id, "left_anti")
    _commit(store, version + 1, after if new is None else after.unionByName(new), held, touched)
    return version + 1
