"""Intents, confidence, citations and answer text over derived questions and responses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import maps
from ledgerlight.operators import answers as ans
from ledgerlight.operators import evaluation as ev
from ledgerlight.operators.parsing import parse_structured
from ledgerlight.plans.questions import QUESTIONS_SQL, RESPONSES_SQL, questions, responses
from ledgerlight.plans.registry import query

# The rules once more, as they are stated, so that the check does not follow the code.
RULES_SQL = r"""CASE
  WHEN regexp_matches(lower(question), '\b(email me|send me|schedule)\b|\b(report|summary|dashboard)\b.*\bevery\b') THEN 'schedule_report'
  WHEN regexp_matches(lower(question), '\b(dcf|npv|irr|payback|sensitivity|net present value|internal rate)\b') THEN 'financial_model'
  WHEN regexp_matches(lower(question), '\b(forecast|predict|projection)\b.*\b(next|for|using|over)\b') THEN 'forecast'
  WHEN regexp_matches(lower(question), '\b(revenue|sales|spend|actual|orders)\b.*\b(report|doc|document|presentation|policy|contract)\b') THEN 'hybrid'
  WHEN regexp_matches(lower(question), '\b(policy|policies|contract|handbook|msa|terms|document|presentation|report)\b') THEN 'document'
  WHEN regexp_matches(lower(question), '\b(total|average|how many|count|top|revenue|sales|price|trend|percentage|by (month|segment|channel|region))\b') THEN 'sql'
  WHEN regexp_matches(lower(question), '^(how are we doing|tell me something|help|what about)\b') THEN 'clarification' END"""
PREDICTED_SQL = f"pred AS (SELECT id, question, intent AS truth, coalesce({RULES_SQL}, 'hybrid') AS predicted, {RULES_SQL} IS NOT NULL AS ruled FROM qs)"


def predicted(t):
    asked = questions(t).withColumnRenamed("intent", "truth")
    return ans.label_intent(asked)


def pairs(t):
    labelled = predicted(t)
    return ev.pair_intents(labelled.select("id", "intent"), questions(t).select("id", "intent"))


@query("ans5_intent_labels", f"""
WITH {QUESTIONS_SQL}, {PREDICTED_SQL}
SELECT id, predicted AS intent, CASE WHEN ruled THEN 0.8 ELSE 0.3 END AS intent_confidence FROM pred
""")
def intents(t):
    return predicted(t).select("id", "intent", "intent_confidence")


@query("ans6_intent_fan_out", f"""
WITH {QUESTIONS_SQL}, {PREDICTED_SQL},
stages(intent, stage) AS (VALUES ('sql','sql'), ('document','documents'), ('hybrid','sql'), ('hybrid','documents'),
  ('financial_model','financial'), ('forecast','forecast'), ('schedule_report','schedule'))
SELECT id, predicted AS intent, stage FROM pred JOIN stages ON intent = predicted
""")
def stages(t):
    return ans.fan_out(predicted(t)).select("id", "intent", "stage")


CONF_SQL = f"""
WITH {RESPONSES_SQL},
parts AS (SELECT *, list_filter([
    CASE WHEN sql_row_count > 0 THEN least(1.0, sql_row_count / 10.0) * 0.8 + 0.2 END,
    CASE WHEN has_docs THEN (value / 500 + value / 1000) / 2 END,
    CASE WHEN has_financial THEN 0.9 END, CASE WHEN has_forecast THEN 0.85 END], lambda x: x IS NOT NULL) AS p FROM resp),
conf AS (SELECT *, CASE WHEN len(p) > 0 THEN list_sum(p) / len(p) ELSE 0.3 END AS confidence FROM parts)
"""


@query("ans1_confidence", CONF_SQL + """
SELECT event_id, ROUND(confidence, 9) AS confidence,
  CASE WHEN confidence < 0.4 THEN 'I don''t have enough information to answer this question.' END AS unknown_response FROM conf
""")
def confident(t):
    return ans.with_confidence(responses(t)).select("event_id", F.round("confidence", 9).alias("confidence"), "unknown_response")


@query("ans2_citations", f"""
WITH {RESPONSES_SQL},
cites AS (SELECT event_id, list_filter([
    CASE WHEN has_financial THEN {{'t': 'financial', 'i': CASE WHEN event_type = 'signup' THEN 'npv' ELSE 'irr' END, 'n': CAST(NULL AS VARCHAR)}} END,
    CASE WHEN has_forecast THEN {{'t': 'forecast', 'i': 'arima', 'n': CAST(NULL AS VARCHAR)}} END,
    CASE WHEN schedule_id IS NOT NULL THEN {{'t': 'schedule', 'i': schedule_id, 'n': CAST(NULL AS VARCHAR)}} END,
    CASE WHEN sql_text IS NOT NULL THEN {{'t': 'sql', 'i': substring(sql_text, 1, 50), 'n': CAST(NULL AS VARCHAR)}} END,
    CASE WHEN has_docs THEN {{'t': 'document', 'i': CAST(user_id AS VARCHAR), 'n': 'doc ' || user_id}} END,
    CASE WHEN has_docs THEN {{'t': 'document', 'i': CAST(event_id AS VARCHAR), 'n': CAST(NULL AS VARCHAR)}} END], lambda x: x IS NOT NULL)[1:5] AS c FROM resp)
SELECT event_id,
  array_to_string(list_transform(c, lambda x: '[source: ' || x.t || ', ' || x.i || ']'), ' ') AS bracket,
  array_to_string(list_transform(c, lambda x: '[' || x.t || ': ' || coalesce(x.n, x.i) || ']'), ' ') AS inline,
  array_to_string(list_transform(range(1, len(c) + 1), lambda x: '[' || x || ']'), ' ') AS footnote
FROM cites
""")
def citations(t):
    cited = responses(t).withColumn("c", ans.citation_structs())
    return cited.select("event_id", *[F.array_join(ans.format_citations(F.col("c"), s), " ").alias(s)
                                      for s in ("bracket", "inline", "footnote")])


def with_texts(t):
    """Responses with the figures and texts of their financial, forecast and schedule parts."""
    fin, fc, sch = F.col("has_financial"), F.col("has_forecast"), F.col("schedule_id").isNotNull()
    return (ans.with_confidence(responses(t))
            .withColumn("financial_text", F.when(fin, F.lit("Done.")))
            .withColumn("npv", F.when(fin & (F.col("financial_model") == "npv"), F.col("value") * 1000))
            .withColumn("irr", F.when(fin & (F.col("financial_model") == "irr"), F.col("value") / 1000))
            .withColumn("dcf_value", F.lit(None).cast("double")).withColumn("payback_period", F.lit(None).cast("double"))
            .withColumn("forecast_text", F.when(fc, F.lit("Rising.")))
            .withColumn("next_date", F.when(fc, F.lit("Period_1"))).withColumn("next_yhat", F.when(fc, F.col("value")))
            .withColumn("next_lower", F.when(fc, F.col("value") * 0.9)).withColumn("next_upper", F.when(fc, F.col("value") * 1.1))
            .withColumn("schedule_name", F.when(sch, F.concat(F.lit("user "), F.col("user_id").cast("string"))))
            .withColumn("schedule_cron", F.when(sch, F.lit("0 9 * * 1")))
            .withColumn("schedule_recipients", F.when(sch, F.array(F.lit("a@example.com"), F.lit("b@example.com"))))
            .withColumn("schedule_format", F.when(sch, F.lit("pdf"))))


@query("ans3_composed_answer", CONF_SQL + r"""
SELECT event_id, nullif(concat_ws(E'\n\n',
  CASE WHEN has_financial THEN 'Financial Model (' || CASE WHEN event_type = 'signup' THEN 'NPV' ELSE 'IRR' END || E'):\nDone.' END,
  CASE WHEN has_financial AND event_type = 'signup' THEN 'NPV: $' || format('{:,.2f}', value * 1000) END,
  CASE WHEN has_financial AND event_type = 'purchase' THEN 'IRR: ' || format('{:.2f}', value / 1000 * 100) || '%' END,
  CASE WHEN has_forecast THEN E'Forecast (ARIMA):\nRising.' END,
  CASE WHEN has_forecast THEN 'Next period: Period_1 = ' || format('{:,.2f}', value) || ' (CI: ' || format('{:,.2f}', value * 0.9) || ' - ' || format('{:,.2f}', value * 1.1) || ')' END,
  CASE WHEN schedule_id IS NOT NULL THEN 'Scheduled report created: ''user ' || user_id || '''' END,
  CASE WHEN schedule_id IS NOT NULL THEN 'Cron: 0 9 * * 1' END,
  CASE WHEN schedule_id IS NOT NULL THEN 'Recipients: a@example.com, b@example.com' END,
  CASE WHEN schedule_id IS NOT NULL THEN 'Format: pdf' END), '') AS answer,
  CASE WHEN confidence < 0.4 THEN 'insufficient' ELSE 'sufficient' END AS data_sufficiency
FROM conf
""")
def composed(t):
    return ans.compose_answer(with_texts(t)).select("event_id", "answer", "data_sufficiency")


@query("ans4_evidence", f"""
WITH {RESPONSES_SQL}
SELECT event_id,
  CASE WHEN sql_row_count IS NULL THEN 'No SQL results.' ELSE 'Query returned ' || sql_row_count || E' rows.\\nColumns: user_id, value\\nSample data: [('
    || user_id || ', ' || format('{{:.2f}}', value) || E')]\\n' END AS sql_evidence,
  CASE WHEN NOT has_docs THEN 'No document results.' ELSE E'Found 2 relevant document chunks:\\n1. [doc ' || user_id || '] (score: '
    || format('{{:.2f}}', value / 500) || '): chunk of ' || event_type || E'...\\n2. [Unknown] (score: '
    || format('{{:.2f}}', value / 1000) || E'): ...\\n' END AS document_evidence
FROM resp
""")
def evidence(t):
    from ledgerlight.functions.formats import plain
    shown = (responses(t)
             .withColumn("sql_columns", F.array(F.lit("user_id"), F.lit("value")))
             .withColumn("sql_rows", F.array(F.concat(F.lit("("), F.col("user_id").cast("string"), F.lit(", "), plain("value"), F.lit(")")))))
    return ans.evidence(shown).select("event_id", "sql_evidence", "document_evidence")


@query("src18_structured_output", """
WITH j AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN err IS NULL THEN CASE WHEN event_type = 'click' THEN 'sql' ELSE 'forecast' END ELSE 'hybrid' END AS intent,
  CASE WHEN err IS NULL THEN ROUND(k / 50.0, 4) ELSE 0.3 END AS confidence, err AS parse_error
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'invalid JSON' WHEN event_type = 'signup' THEN 'missing field: intent'
  WHEN event_type = 'view' THEN 'unknown intent' WHEN k > 50 THEN 'confidence out of range' END AS err FROM j)
""")
def structured(t):
    k = maps.json_field("props", "$.k", "int")
    share = F.round(k / 50, 4).cast("string")
    kind = F.col("event_type")
    name = F.when(kind == "click", "sql").when(kind == "purchase", "forecast").when(kind == "view", "poetry")
    text = (F.when(kind == "error", F.concat(F.lit("not json "), F.col("props")))
            .when(kind == "signup", F.concat(F.lit('{"confidence": '), share, F.lit("}")))
            .otherwise(F.concat(F.lit('{"intent": "'), name, F.lit('", "confidence": '), share, F.lit(', "reasoning": "r"}'))))
    schema = T.StructType([T.StructField("intent", T.StringType()), T.StructField("confidence", T.DoubleType())])
    out = parse_structured(
        t.events.select("event_id", text.alias("text")), "text", schema,
        {"unknown intent": F.col("parsed.intent").isin(*ev.INTENTS),
         "confidence out of range": F.col("parsed.confidence").between(0.0, 1.0)},
        required=("intent", "confidence"), fallback={"intent": F.lit("hybrid"), "confidence": F.lit(0.3)})
    return out.select("event_id", "parsed.intent", "parsed.confidence", "parse_error")
