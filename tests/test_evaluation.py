from math import log2

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import evaluation as ev


def test_retrieval_measures(spark):
    hits = spark.createDataFrame([("q", "r1", 1), ("q", "x", 2), ("q", "r2", 3), ("none", "x", 1)], ["query_id", "item_id", "rank"])
    rel = spark.createDataFrame([("q", "r1"), ("q", "r2"), ("none", "r9"), ("nohits", "r1")], ["query_id", "item_id"])
    at = {(r.query_id, r.k): r for r in ev.retrieval_at_k(hits, rel).collect()}
    assert at["q", 1].precision == 1 and at["q", 1].recall == 0.5
    assert at["q", 3].precision == pytest.approx(2 / 3) and at["q", 3].recall == 1
    assert at["q", 10].precision == 0.2 and at["nohits", 5].recall == 0
    assert at["q", 3].ndcg == pytest.approx((1 + 1 / log2(4)) / (1 + 1 / log2(3)))
    ranks = {r.query_id: (r.reciprocal_rank, r.hit_rate) for r in ev.rank_metrics(hits, rel).collect()}
    assert ranks == {"q": (1.0, 1.0), "none": (0.0, 0.0), "nohits": (0.0, 0.0)}


def test_sql_text_match(one):
    assert one(ev.sql_exact_match("a", "b"), a=" SELECT  1\n", b="select 1") == 1.0
    assert one(ev.sql_exact_match("a", "b"), a="select 2", b="select 1") == 0.0


def test_sql_execution_match(spark, sample):
    sources = {"orders": f"{sample}/orders.parquet"}
    pairs = [
        ("same", "SELECT o_orderstatus AS s FROM orders", "SELECT DISTINCT o_orderstatus FROM orders ORDER BY 1 DESC"),
        ("other", "SELECT count(*) FROM orders", "SELECT count(*) + 1 FROM orders"),
        ("wider", "SELECT 1, 2", "SELECT 1"),
        ("broken", "SELECT nothing FROM orders", "SELECT 1"),
        ("forbidden", "DROP TABLE orders", "SELECT 1"),
    ]
    got = {r.id: (r.valid_sql_rate, r.execution_accuracy) for r in ev.sql_execution_match(spark, pairs, sources).collect()}
    assert got == {"same": (1, 1), "other": (1, 0), "wider": (1, 0), "broken": (0, 0), "forbidden": (0, 0)}


def test_faithfulness(spark):
    text = "Revenue was up [source: sql, SELECT]. Policy says so [source: document, d1]! Title works [source: document, Handbook]? No source. Bad [source: forecast, x]."
    df = spark.createDataFrame([(text, True, False, False, [("d1", "Handbook")]), ("", True, True, True, [])],
                               "answer string, has_sql boolean, has_financial boolean, has_forecast boolean, documents array<struct<document_id:string,title:string>>")
    full, empty = ev.faithfulness(df).collect()
    assert (full.claims_total, full.claims_supported, full.citations_total, full.citations_valid) == (5, 3, 4, 3)
    assert full.faithfulness_score == 0.6 and full.citation_precision == 0.75 and full.hallucination_rate == pytest.approx(0.4)
    assert (empty.faithfulness_score, empty.citation_precision, empty.citation_recall, empty.hallucination_rate) == (1, 1, 1, 0)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "predicted string, truth string")


def test_class_metrics(spark):
    df = pairs(spark, [("sql", "sql"), ("document", "document"), ("sql", "hybrid"), ("forecast", "forecast"), ("sql", "sql")])
    assert ev.accuracy(df).first().accuracy == 0.8
    by = {r.intent: r for r in ev.class_metrics(df).collect()}
    assert len(by) == 7 and by["sql"].precision == pytest.approx(2 / 3) and by["sql"].recall == 1 and by["hybrid"].f1 == 0
    assert ev.macro_f1(df).first().macro_f1 == pytest.approx((0.8 + 1 + 1) / 7)
    tools = ev.tool_selection(df).first()
    assert (tools.sql_vs_rag_correct, tools.hybrid_routing_correct, tools.schedule_correct) == (1, 0, 1)
    assert {(r.truth, r.predicted): r.n for r in ev.confusion(df).collect()}["hybrid", "sql"] == 1
    assert {r.truth: r.sql for r in ev.confusion_wide(df).collect()}["sql"] == 2


def test_class_metrics_of_nothing(spark):
    none = pairs(spark, [])
    assert ev.class_metrics(none).count() == 7 and ev.accuracy(none).first().accuracy == 0 and ev.tool_selection(none).first().accuracy == 0


def test_pairs_must_cover_the_same_ids(spark):
    a = spark.createDataFrame([(1, "sql"), (2, "sql")], ["id", "intent"])
    assert ev.pair_intents(a, a).count() == 2
    with pytest.raises(Exception, match="same ids"):
        ev.pair_intents(a, a.where("id = 1")).collect()


def test_evaluate(spark):
    questions = spark.createDataFrame([("1", "a?", "document", ["d1"]), ("2", "b?", "sql", []), ("3", "c?", "document", ["d9"])],
                                      "id string, question string, intent string, relevant_doc_ids array<string>")
    responses = spark.createDataFrame(
        [("1", "document", "Yes [source: document, d1].", 10.0, 0.8), ("2", "sql", "No source here.", 20.0, 0.4), ("3", "document", "", 30.0, 0.3)],
        "id string, intent string, answer string, latency_ms double, confidence double")
    for flag in ("has_sql", "has_financial", "has_forecast"):
        responses = responses.withColumn(flag, F.lit(False))
    responses = responses.withColumn("documents", F.array(F.struct(F.lit("d1").alias("document_id"), F.lit("t").alias("title"))))
    hits = spark.createDataFrame([("1", "x", 1), ("1", "d1", 2), ("3", "x", 1)], ["query_id", "item_id", "rank"])
    checks = spark.createDataFrame([("2", 1.0)], ["id", "execution_accuracy"])
    out = {r.id: r for r in ev.evaluate(questions, responses, hits, checks).collect()}
    assert out["1"].passed and out["1"].reciprocal_rank == 0.5
    assert not out["2"].passed and out["2"].hit_rate is None and out["2"].execution_accuracy == 1
    assert not out["3"].passed and out["3"].hit_rate == 0
    summary = ev.eval_summary(ev.evaluate(questions, responses, hits, checks)).first()
    assert (summary.total, summary.passed, summary.retrieval_hit_rate, summary.avg_latency_ms) == (3, 1, 0.5, 20.0)
