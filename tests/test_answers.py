import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import maps
from ledgerlight.operators import answers as ans
from ledgerlight.operators.parsing import parse_structured


@pytest.mark.parametrize("question, intent", [
    ("What was our total revenue in the third quarter?", "sql"),
    ("How many active customers do we have?", "sql"),
    ("What is our refund policy for large customers?", "document"),
    ("Compare actual revenue to the forecast in the board presentation", "hybrid"),
    ("Build a DCF model with 15% discount rate", "financial_model"),
    ("What is the IRR for an investment of -50000?", "financial_model"),
    ("Forecast revenue for next 12 months", "forecast"),
    ("Email me the revenue report every Monday", "schedule_report"),
    ("How are we doing?", "clarification"),
    ("blue", "hybrid"),
])
def test_intents(spark, question, intent):
    row = ans.label_intent(spark.createDataFrame([(question,)], ["question"])).first()
    assert row.intent == intent and row.intent_confidence == (0.3 if question == "blue" else 0.8)


def test_given_intent_wins_and_fans_out(spark):
    df = spark.createDataFrame([(1, "x", "hybrid"), (2, "x", "clarification"), (3, "Forecast sales for next year", None)], "id int, question string, given string")
    out = ans.fan_out(ans.label_intent(df, given="given"))
    assert sorted((r.id, r.stage) for r in out.collect()) == [(1, "documents"), (1, "sql"), (3, "forecast")]


@pytest.mark.parametrize("rows, scores, fin, fc, want", [
    (None, [], False, False, 0.3), (0, [], False, False, 0.3), (10, [], False, False, 1.0), (5, [], False, False, 0.6),
    (1, [], False, False, 0.28), (None, [0.8, 0.6], False, False, 0.7), (None, [], True, True, 0.875), (100, [0.5], True, True, 0.8125),
])
def test_confidence(spark, rows, scores, fin, fc, want):
    df = spark.createDataFrame([(rows, scores, fin, fc)], "sql_row_count int, document_scores array<double>, has_financial boolean, has_forecast boolean")
    row = ans.with_confidence(df).first()
    assert row.confidence == pytest.approx(want)
    assert (row.unknown_response is not None) == (want < 0.4)


def test_citations_are_cut_to_five(spark):
    docs = [(str(i), f"t{i}" if i else None) for i in range(4)]
    df = spark.createDataFrame([("npv", "arima", "s1", "S" * 80, docs)],
                               "financial_model string, forecast_model string, schedule_id string, sql_text string, documents array<struct<document_id:string,title:string>>")
    row = df.select(*[ans.format_citations(ans.citation_structs(), s).alias(s) for s in ("bracket", "inline", "footnote")]).first()
    assert row.bracket == ["[source: financial, npv]", "[source: forecast, arima]", "[source: schedule, s1]", f"[source: sql, {'S' * 50}]", "[source: document, 0]"]
    assert row.inline[4] == "[document: 0]" and row.footnote == ["[1]", "[2]", "[3]", "[4]", "[5]"]


def test_parse_structured(spark):
    schema = T.StructType([T.StructField("intent", T.StringType()), T.StructField("confidence", T.DoubleType())])
    texts = ['{"intent": "sql", "confidence": 0.9, "extra": 1}', "invalid json", '{"intent": "dance", "confidence": 0.9}',
             '{"intent": "sql", "confidence": 7}', '{"confidence": 0.5}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = parse_structured(df, "t", schema, {"unknown intent": F.col("parsed.intent").isin("sql"), "out of range": F.col("parsed.confidence").between(0, 1)},
                           required=("intent",), fallback={"intent": F.lit("hybrid"), "confidence": F.lit(0.3)}).orderBy("i").collect()
    assert [r.parse_error for r in out] == [None, "invalid JSON", "unknown intent", "out of range", "missing field: intent", "invalid JSON"]
    assert [r.parsed.intent for r in out] == ["sql"] + ["hybrid"] * 5


def test_sensitive_values(spark):
    df = spark.createDataFrame([({"Password": "p", "token": "", "name": "n"},)], "m map<string,string>")
    key = F.lit("0123456789abcdef")
    row = df.select("m", maps.protect("m", key).alias("c"), maps.reveal(maps.protect("m", key), key).alias("o"), maps.reveal("m", key).alias("same")).first()
    assert row.c["Password"] != "p" and row.c["name"] == "n" and row.c["token"] == ""
    assert row.o == row.m and row.same == row.m
