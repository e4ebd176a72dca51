"""Derived question, response and pair tables shared by the answer and evaluation queries.

Each part asks one question; its wording follows the part's type and size. Each event is one
response, its parts read from the event's type, value and properties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions.maps import json_field

# (intent, opening, ending) by part type; the part name stands between. Two sizes of wording.
SMALL_PARTS = {
    "ECONOMY": ("sql", "What was the total revenue of ", " by month?"),
    "LARGE": ("document", "What does the contract say about ", "?"),
    "MEDIUM": ("financial_model", "Calculate NPV for ", " at 10% discount"),
    "PROMO": ("forecast", "Forecast demand of ", " for next 12 months"),
    "SMALL": ("schedule_report", "Email me the numbers of ", " every Monday 9am"),
    "STANDARD": ("hybrid", "Compare actual sales of ", " to the board presentation"),
}
BIG_PARTS = {
    "ECONOMY": ("clarification", "How are we doing with ", "?"),
    "LARGE": ("hybrid", "Explain the anomaly of ", " per the quarterly report"),
    "MEDIUM": ("sql", "Show me the price of ", ""),
    "PROMO": ("forecast", "Where will ", " go from here"),
    "SMALL": ("schedule_report", "Weekly delivery of ", " dashboard, every Friday"),
    "STANDARD": ("document", "Find the handbook section on ", " orders policy"),
}
SMALL_SIZE = 30


def questions(t):
    text, intent = None, None
    for table, test in ((SMALL_PARTS, F.col("p_size") < SMALL_SIZE), (BIG_PARTS, F.col("p_size") >= SMALL_SIZE)):
        for kind, (name, opening, ending) in table.items():
            here = test & (F.col("p_type") == kind)
            words = F.concat(F.lit(opening), F.col("p_name"), F.lit(ending))
            text = F.when(here, words) if text is None else text.when(here, words)
            intent = F.when(here, F.lit(name)) if intent is None else intent.when(here, F.lit(name))
    return t.part.select(F.col("p_partkey").alias("id"), text.alias("question"), intent.alias("intent"))


def _cases(position: int) -> str:
    out = []
    for table, test in ((SMALL_PARTS, f"p_size < {SMALL_SIZE}"), (BIG_PARTS, f"p_size >= {SMALL_SIZE}")):
        for kind, row in table.items():
            value = f"'{row[0]}'" if position == 0 else f"'{row[1]}' || p_name || '{row[2]}'"
            out.append(f"WHEN {test} AND p_type = '{kind}' THEN {value}")
    return "CASE " + " ".join(out) + " END"


QUESTIONS_SQL = f"qs AS (SELECT p_partkey AS id, {_cases(1)} AS question, {_cases(0)} AS intent FROM part)"


def responses(t):
    """One response per event; which parts it has follows the event type."""
    k = json_field("props", "$.k", "int")
    kind = F.col("event_type")
    base = t.events.select("event_id", "ts", "user_id", kind.alias("event_type"), "value", k.alias("k"))
    score = F.col("value") / 500
    document = F.struct(F.col("user_id").cast("string").alias("document_id"),
                        F.concat(F.lit("doc "), F.col("user_id").cast("string")).alias("title"), score.alias("score"),
                        F.concat(F.lit("chunk of "), F.col("event_type")).alias("chunk_content"))
    second = F.struct(F.col("event_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("title"),
                      (score / 2).alias("score"), F.lit("").alias("chunk_content"))
    has_docs = kind.isin("click", "view")
    financial = kind.isin("signup", "purchase") & (F.col("k") < 50)
    forecast = (kind == "purchase") & (F.col("k") % 2 == 0)
    return (base
            .withColumn("sql_row_count", F.when(kind.isin("purchase", "view", "error"), F.col("k")))
            .withColumn("sql_text", F.when(F.col("sql_row_count").isNotNull(),
                                           F.concat(F.lit("SELECT value FROM events WHERE user_id = "), F.col("user_id").cast("string"),
                                                    F.lit(" AND event_type = 'x'"))))
            .withColumn("documents", F.when(has_docs, F.array(document, second)).otherwise(F.array().cast(
                "array<struct<document_id:string,title:string,score:double,chunk_content:string>>")))
            .withColumn("document_scores", F.transform("documents", lambda d: d["score"]))
            .withColumn("has_financial", financial).withColumn("has_forecast", forecast)
            .withColumn("financial_model", F.when(financial, F.when(kind == "signup", "npv").otherwise("irr")))
            .withColumn("forecast_model", F.when(forecast, F.lit("arima")))
            .withColumn("schedule_id", F.when((kind == "click") & (F.col("k") > 80), F.col("event_id").cast("string"))))


RESPONSES_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
resp AS (SELECT *,
  CASE WHEN event_type IN ('purchase', 'view', 'error') THEN k END AS sql_row_count,
  CASE WHEN event_type IN ('purchase', 'view', 'error') THEN 'SELECT value FROM events WHERE user_id = ' || user_id || ' AND event_type = ''x''' END AS sql_text,
  event_type IN ('click', 'view') AS has_docs,
  event_type IN ('signup', 'purchase') AND k < 50 AS has_financial,
  event_type = 'purchase' AND k % 2 = 0 AS has_forecast,
  CASE WHEN event_type = 'click' AND k > 80 THEN CAST(event_id AS VARCHAR) END AS schedule_id
  FROM ev)
"""


def cited_answers(t):
    """Assistant turns with sources quoted after their first and last sentence."""
    k = F.col("conv_id") % 4
    source = (F.when(k == 0, F.concat(F.lit("[source: sql, SELECT "), F.col("turn").cast("string"), F.lit("]")))
              .when(k == 1, F.concat(F.lit("[source: document, "), F.col("conv_id").cast("string"), F.lit("]")))
              .when(k == 2, F.lit("[source: document, missing]")).otherwise(F.lit("[source: schedule, x]")))
    text = F.concat(F.regexp_replace("text", r"\.", F.lit(" ")), F.lit(" "), source, F.lit(". As stated "),
                    F.lit("[source:forecast, arima]! "), F.col("text"))
    turns = t.conversations.where(F.col("role") == "assistant")
    return turns.select(
        "conv_id", "turn", text.alias("answer"), (F.col("turn") % 2 == 1).alias("has_sql"), F.lit(False).alias("has_financial"),
        (F.col("conv_id") % 3 == 0).alias("has_forecast"),
        F.array(F.struct(F.col("conv_id").cast("string").alias("document_id"), F.lit("t").alias("title"))).alias("documents"))


CITED_SQL = """
ans AS (SELECT conv_id, turn,
  replace(text, '.', ' ') || ' ' || CASE conv_id % 4 WHEN 0 THEN '[source: sql, SELECT ' || turn || ']'
    WHEN 1 THEN '[source: document, ' || conv_id || ']' WHEN 2 THEN '[source: document, missing]' ELSE '[source: schedule, x]' END
    || '. As stated [source:forecast, arima]! ' || text AS answer,
  turn % 2 = 1 AS has_sql, conv_id % 3 = 0 AS has_forecast
  FROM conversations WHERE role = 'assistant')
"""
