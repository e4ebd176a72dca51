"""Sources and sinks: what is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import documents as docs
from ledgerlight.plans.documents import FIXED_SQL, texts
from ledgerlight.plans.questions import QUESTIONS_SQL, questions
from ledgerlight.plans.registry import query
from ledgerlight.session import spread
from ledgerlight.sources import catalog, sinks, store
from ledgerlight.streaming import ingest
from ledgerlight.streaming.jobs import scratch

# Spark's names of the column types of the sample tables, by DuckDB's.
TYPES_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float'
  WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"""


def _keys_sql(kind: str) -> str:
    pairs = [f"('{table}', '{column}')" for table, keys in catalog.TABLE_KEYS.items() for column in keys[kind]]
    return f"(table_name, column_name) IN ({', '.join(pairs)})"


@query("src3_schema_rows", f"""
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {TYPES_SQL} AS data_type,
  {_keys_sql('primary')} AS is_primary_key, {_keys_sql('foreign')} AS is_foreign_key
FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{name}'" for name in catalog.TABLES)})
""")
def schema_rows(t):
    tables = {name: catalog.read_table(t.spark, t.folder, name) for name in catalog.TABLES}
    rows = catalog.schema_table(t.spark, tables, catalog.TABLE_KEYS)
    return rows.select("table_name", "ordinal", "column_name", "data_type", "is_primary_key", "is_foreign_key")


@query("src6_scan_files", """
SELECT sha256(text || chr(10)) AS content_hash, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size_bytes, COUNT(*) AS n_files
FROM documents WHERE lang = 'es' GROUP BY ALL
""")
def scanned(t):
    """Documents of one language written as a file each, and scanned as files."""
    folder = scratch(t.spark, "files")
    t.documents.where("lang = 'es'").select("doc_id", "text").write.partitionBy("doc_id").text(folder)
    found = docs.scan_documents(t.spark, folder)
    return found.groupBy(F.sha2("content", 256).alias("content_hash"), "size_bytes").agg(F.count(F.lit(1)).alias("n_files"))


@query("src10_question_set", f"""
WITH {QUESTIONS_SQL}
SELECT CAST(id AS VARCHAR) AS id, question, intent, CAST(NULL AS VARCHAR) AS expected_sql,
  CASE WHEN id % 3 = 0 THEN [CAST(id AS VARCHAR)] ELSE [] END AS relevant_doc_ids FROM qs
""")
def question_set(t):
    """Questions written as JSON, without the fields that are empty, and read back as a question set."""
    folder = scratch(t.spark, "questions")
    relevant = F.when(F.col("id") % 3 == 0, F.array(F.col("id").cast("string")))
    sinks.write_json(questions(t).select(F.col("id").cast("string").alias("id"), "question", "intent", relevant.alias("relevant_doc_ids")), folder)
    return sinks.read_questions(t.spark, folder, lines=True)


CSV_SQL = "SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem"


@query("src14_csv_sink", f"SELECT *, true AS has_rows, false AS empty_has_rows FROM ({CSV_SQL})")
def csv_rows(t):
    rows, path = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), scratch(t.spark, "csv")
    wrote, none = sinks.write_csv(rows, path), sinks.write_csv(rows.where("l_orderkey IS NULL"), f"{path}_none")
    back = t.spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.withColumn("has_rows", F.lit(wrote)).withColumn("empty_has_rows", F.lit(none))


@query("src17_json_export", """
SELECT o_custkey AS id, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, list_sort(list(o_orderkey)) AS order_keys FROM orders GROUP BY o_custkey
""")
def exported(t):
    """Nested results written as JSON and read back."""
    nested = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).alias("sums"),
        F.array_sort(F.collect_list("o_orderkey")).alias("order_keys"))
    path = scratch(t.spark, "json")
    sinks.write_json(nested, path)
    return t.spark.read.schema(nested.schema).json(path).select("id", "sums.n", "sums.total", "order_keys")


@query("src11_chunk_store", FIXED_SQL + """
, first AS (SELECT 1 AS version, document_id, chunk_index, content FROM chunks),
last AS (SELECT 3 AS version, document_id, chunk_index, CASE WHEN document_id % 20 = 3 THEN 'new: ' || content ELSE content END AS content
  FROM chunks WHERE document_id % 20 <> 7 AND NOT (document_id % 20 = 3 AND chunk_index > 0))
SELECT * FROM first UNION ALL SELECT * FROM last
""")
def chunk_store(t):
    """A store in which a twentieth of the documents are replaced and a twentieth deleted; its first and its last version."""
    chunks = docs.chunk_fixed(texts(t)).select("document_id", "chunk_id", "chunk_index", "content")
    held = store.create_store(chunks, scratch(t.spark, "store"), buckets=32)
    changed = chunks.where("document_id % 20 = 3 AND chunk_index = 0").withColumn("content", F.concat(F.lit("new: "), "content"))
    store.change_store(held, chunks=changed)
    last = store.change_store(held, removed=t.documents.where("doc_id % 20 = 7").select(F.col("doc_id").alias("document_id")))
    return store.read_store(held, 1).withColumn("version", F.lit(1)).unionByName(
        store.read_store(held, last).withColumn("version", F.lit(last))).select("version", "document_id", "chunk_index", "content")


@query("doc8_ingest_stream", """
WITH d AS (SELECT DISTINCT text || chr(10) AS text FROM documents WHERE lang = 'es' AND trim(text, E' \\n\\t\\r') <> ''),
win AS (SELECT text, unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 200) / 800.0) AS BIGINT) END)) AS i FROM d)
SELECT sha256(text) AS document_id, COUNT(*) AS n_chunks, SUM(length(substring(text, CAST(i * 800 + 1 AS BIGINT), 1000)))::BIGINT AS chars FROM win GROUP BY text
""")
def streamed(t):
    """Two runs over a folder that grows: half of the documents, then all of them, so half of the contents come again."""
    folder, path, progress = (scratch(t.spark, name) for name in ("files", "ingest", "progress"))
    rows = t.documents.where("lang = 'es'").select("doc_id", "text")
    for name, part in (("first", rows.where("doc_id % 2 = 0")), ("second", rows)):
        # A file per document, all in one folder: a folder for each would be a task for each whenever files are listed.
        spread(part.select("text")).write.option("maxRecordsPerFile", 1).option(
            "mapreduce.fileoutputcommitter.algorithm.version", 2).text(f"{folder}/{name}")
        ingest.ingest_stream(t.spark, folder, path, progress, "fixed", available_now=True).awaitTermination()
    chunks = ingest.ingested(t.spark, path).chunks()
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.char_length("content")).alias("chars"))
