import json

from pyspark.sql import functions as F

from ledgerlight.operators import documents as docs
from ledgerlight.sources import catalog, sinks


def test_schema_table(spark, sample):
    tables = {"nation": catalog.read_table(spark, sample, "nation"), "orders": catalog.read_table(spark, sample, "orders")}
    rows = {(r.table_name, r.column_name): r for r in catalog.schema_table(spark, tables, catalog.TABLE_KEYS).collect()}
    assert len(rows) == 9
    assert rows["orders", "o_orderkey"].is_primary_key and not rows["orders", "o_orderkey"].is_foreign_key
    assert rows["nation", "n_regionkey"].is_foreign_key and rows["nation", "n_regionkey"].data_type == "int"
    assert rows["orders", "o_orderdate"].data_type == "timestamp_ntz" and rows["orders", "o_orderdate"].ordinal == 5


def test_sample_rows(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("id"))
    assert [r.id for r in catalog.sample_rows(df, ["id"]).collect()] == [0, 1, 2]


def test_jdbc_options():
    options = catalog.jdbc_options({"dialect": "postgresql", "host": "h", "port": 5433, "dbname": "d", "username": "u",
                                    "password": "p", "numPartitions": 8}, "orders")
    assert options["url"] == "jdbc:postgresql://h:5433/d" and options["user"] == "u" and options["numPartitions"] == "8"
    assert "read_only" in options["sessionInitStatement"]
    assert catalog.jdbc_options({"dialect": "mysql", "database": "d", "query": {"a": 1}}, "t")["url"] == "jdbc:mysql://localhost:5432/d?a=1"


def test_questions(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([
        {"id": "a", "question": "total?", "intent": "sql", "expected_sql": "SELECT 1", "relevant_doc_ids": []},
        {"id": "b", "question": "policy?", "intent": "document", "relevant_doc_ids": ["d1"]},
        {"id": "c", "question": "hm?"}]))
    rows = {r.id: r for r in sinks.read_questions(spark, str(path)).collect()}
    assert len(rows) == 3 and rows["b"].expected_sql is None and rows["b"].relevant_doc_ids == ["d1"] and rows["c"].relevant_doc_ids == []
    assert sinks.read_questions(spark, str(path), 2).count() == 2


def test_chunk_store_round_trip(spark, tmp_path):
    base = spark.createDataFrame([(1, "s1", "words " * 400, "t1"), (2, "s2", "short", "t2")], ["document_id", "source", "text", "title"])
    with_meta = base.withColumn("metadata", F.create_map(F.lit("owner"), F.lit("me")))
    chunks = docs.flatten_metadata(docs.embed(docs.chunk_recursive(with_meta)), ["owner", "document_title"])
    sinks.write_chunks(chunks, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.count() == chunks.count() > 2
    assert (tmp_path / "store" / "source=s1").is_dir()
    row = back.where("document_id = 2").first()
    assert (row.owner, row.document_title, row.content, len(row.embedding)) == ("me", "t2", "short", docs.HASH_DIMENSION)


def test_tables_are_removed_with_their_block(spark, tmp_path):
    import os

    from ledgerlight import tables_removed
    from ledgerlight.session import cut_lineage

    outside = cut_lineage(spark.range(3))
    with tables_removed(spark):
        inside = cut_lineage(spark.range(5))
        folder = os.path.dirname(inside.inputFiles()[0].replace("file://", ""))
        cut_lineage(inside.where("id > 1")).write.parquet(str(tmp_path / "result"))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and outside.count() == 3
    assert spark.read.parquet(str(tmp_path / "result")).count() == 3


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b,c")], ["id", "name"]).coalesce(1)
    assert sinks.write_csv(df, str(tmp_path / "out")) is True
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["id,name", "1,a", '2,"b,c"']
    assert next((tmp_path / "out_preface").glob("*.txt")).read_text().strip() == "# SQL Results"
    assert sinks.write_csv(df.where("id > 9"), str(tmp_path / "none")) is False
    assert not (tmp_path / "none_preface").exists()


def test_json_export_keeps_nesting(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], ["id", "score"]).select("id", F.struct("score").alias("sql"))
    sinks.write_json(df.coalesce(1), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("*.json")).read_text()) == {"id": 1, "sql": {"score": 0.5}}
