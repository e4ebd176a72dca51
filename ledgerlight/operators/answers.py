"""From question and result parts to intent, confidence, citations and text, row by row.

A response row carries its parts as columns: ``sql_row_count``, ``sql_text``, ``documents``
(array of structs document_id, title, score, chunk_content cut to the answer's hits), and the
financial, forecast and schedule columns named below. Every operator is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.formats import grouped, percent, plain
from ledgerlight.functions.text import snippet

UNKNOWN_RESPONSE = "I don't have enough information to answer this question."
CONFIDENCE_THRESHOLD = 0.4
EMPTY_CONFIDENCE = 0.3
FINANCIAL_CONFIDENCE = 0.9
FORECAST_CONFIDENCE = 0.85
UNKNOWN_TITLE = "Unknown"
MAX_CITATIONS = 5
RULE_CONFIDENCE = 0.8

# Keyword rules, first match wins.
INTENT_RULES = (
    ("schedule_report", r"\b(email me|send me|schedule)\b|\b(report|summary|dashboard)\b.*\bevery\b"),
    ("financial_model", r"\b(dcf|npv|irr|payback|sensitivity|net present value|internal rate)\b"),
    ("forecast", r"\b(forecast|predict|projection)\b.*\b(next|for|using|over)\b"),
    ("hybrid", r"\b(revenue|sales|spend|actual|orders)\b.*\b(report|doc|document|presentation|policy|contract)\b"),
    ("document", r"\b(policy|policies|contract|handbook|msa|terms|document|presentation|report)\b"),
    ("sql", r"\b(total|average|how many|count|top|revenue|sales|price|trend|percentage|by (month|segment|channel|region))\b"),
    ("clarification", r"^(how are we doing|tell me something|help|what about)\b"),
)

# Which stages an intent runs.
INTENT_STAGES = {
    "sql": ("sql",),
    "document": ("documents",),
    "hybrid": ("sql", "documents"),
    "financial_model": ("financial",),
    "forecast": ("forecast",),
    "schedule_report": ("schedule",),
    "clarification": (),
}


def label_intent(df: DataFrame, question: str = "question", given: str | None = None) -> DataFrame:
    """Adds ``intent`` and ``intent_confidence``; a given intent wins over the rules."""
    q = F.lower(F.col(question))
    intent = None
    for name, pattern in INTENT_RULES:
        test = q.rlike(pattern)
        intent = F.when(test, F.lit(name)) if intent is None else intent.when(test, F.lit(name))
    confidence = F.when(intent.isNotNull(), F.lit(RULE_CONFIDENCE)).otherwise(F.lit(EMPTY_CONFIDENCE))
    ruled = F.coalesce(intent, F.lit("hybrid"))
    chosen = F.coalesce(F.col(given), ruled) if given else ruled
    return df.withColumn("intent", chosen).withColumn("intent_confidence", confidence)


def fan_out(df: DataFrame, intent: str = "intent") -> DataFrame:
    """One row per question and stage its intent runs; no stage, no row."""
    stages = F.create_map(*[x for name, parts in INTENT_STAGES.items()
                            for x in (F.lit(name), F.array(*map(F.lit, parts)).cast("array<string>"))])
    return df.withColumn("stage", F.explode(F.try_element_at(stages, F.col(intent))))


def confidence(sql_row_count: str = "sql_row_count", document_scores: str = "document_scores",
               has_financial: str = "has_financial", has_forecast: str = "has_forecast") -> Column:
    """Mean over the parts a response has; 0.3 when it has none."""
    rows = F.col(sql_row_count)
    scores = F.col(document_scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    parts = F.filter(F.array(
        F.when(rows > 0, F.least(F.lit(1.0), rows / 10.0) * 0.8 + 0.2),
        F.when(F.size(scores) > 0, mean),
        F.when(F.col(has_financial), F.lit(FINANCIAL_CONFIDENCE)),
        F.when(F.col(has_forecast), F.lit(FORECAST_CONFIDENCE))), lambda x: x.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(F.lit(EMPTY_CONFIDENCE))


def with_confidence(df: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, **columns: str) -> DataFrame:
    """Adds ``confidence`` and, below the threshold, ``unknown_response``."""
    return (df.withColumn("confidence", confidence(**columns))
            .withColumn("unknown_response", F.when(F.col("confidence") < threshold, F.lit(UNKNOWN_RESPONSE))))


def citation_structs() -> Column:
    """Cited sources in order: financial, forecast, schedule, SQL, first three documents."""
    kind = "struct<type:string,id:string,title:string>"

    def one(name: str, key: Column, present: Column) -> Column:
        item = F.struct(F.lit(name).alias("type"), key.cast("string").alias("id"), F.lit(None).cast("string").alias("title"))
        return F.when(present, F.array(item)).otherwise(F.array().cast(f"array<{kind}>"))

    documents = F.transform(F.slice(F.coalesce("documents", F.array()), 1, 3),
                            lambda d: F.struct(F.lit("document").alias("type"), d["document_id"].cast("string").alias("id"),
                                               d["title"].alias("title")))
    everything = F.concat(
        one("financial", F.col("financial_model"), F.col("financial_model").isNotNull()),
        one("forecast", F.col("forecast_model"), F.col("forecast_model").isNotNull()),
        one("schedule", F.col("schedule_id"), F.col("schedule_id").isNotNull()),
        one("sql", snippet("sql_text", 50), F.col("sql_text").isNotNull()),
        documents)
    return F.slice(everything, 1, MAX_CITATIONS)


def format_citations(structs: Column, style: str = "bracket") -> Column:
    """Citation texts as ``[source: type, id]``, ``[type: title]`` or ``[n]``."""
    if style == "inline":
        return F.transform(structs, lambda c: F.concat(F.lit("["), c["type"], F.lit(": "),
                                                       F.coalesce(F.nullif(c["title"], F.lit("")), c["id"]), F.lit("]")))
    if style == "footnote":
        return F.transform(structs, lambda _c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")))
    return F.transform(structs, lambda c: F.concat(F.lit("[source: "), c["type"], F.lit(", "), c["id"], F.lit("]")))


def compose_answer(df: DataFrame) -> DataFrame:
    """Adds ``answer`` from the financial, forecast and schedule parts, and ``data_sufficiency``.

    The answer is null when there is none of the three; text for SQL and documents alone is
    written by whoever narrates :func:`evidence`. Needs ``confidence`` and ``unknown_response``.
    """
    fin, fc, sch = (F.col(c).isNotNull() for c in ("financial_model", "forecast_model", "schedule_name"))

    def line(test: Column, *parts: Column | str) -> Column:
        return F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    lines = F.array(
        line(fin, "Financial Model (", F.upper("financial_model"), "):\n", F.coalesce("financial_text", F.lit(""))),
        line(fin, "NPV: $", grouped("npv")),
        line(fin, "IRR: ", percent("irr")),
        line(fin, "DCF Value: $", grouped("dcf_value")),
        line(fin, "Payback: ", plain("payback_period"), " years"),
        line(fc, "Forecast (", F.upper("forecast_model"), "):\n", F.coalesce("forecast_text", F.lit(""))),
        line(fc, "Next period: ", F.col("next_date"), " = ", grouped("next_yhat"), " (CI: ", grouped("next_lower"),
             " - ", grouped("next_upper"), ")"),
        line(sch, "Scheduled report created: '", F.col("schedule_name"), "'"),
        line(sch, "Cron: ", F.col("schedule_cron")),
        line(sch, "Recipients: ", F.array_join("schedule_recipients", ", ")),
        line(sch, "Format: ", F.col("schedule_format")))
    text = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n\n")
    return (df.withColumn("answer", F.when(fin | fc | sch, text))
            .withColumn("data_sufficiency", F.when(F.col("unknown_response").isNull(), "sufficient").otherwise("insufficient")))


def evidence(df: DataFrame, sql_rows: str = "sql_rows", sql_columns: str = "sql_columns") -> DataFrame:
    """Adds ``sql_evidence`` and ``document_evidence``, the text a narrator is given.

    ``sql_rows`` is an array of row texts, of which three are shown.
    """
    rows, documents = F.col(sql_rows), F.col("documents")
    sample = F.when(F.size(rows) > 0, F.concat(F.lit("Sample data: ["), F.array_join(F.slice(rows, 1, 3), ", "), F.lit("]\n")))
    sql = F.concat(F.lit("Query returned "), F.col("sql_row_count").cast("string"), F.lit(" rows.\nColumns: "),
                   F.array_join(sql_columns, ", "), F.lit("\n"), F.coalesce(sample, F.lit("")))
    shown = F.transform(F.slice(documents, 1, 3), lambda d, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), F.coalesce(d["title"], F.lit(UNKNOWN_TITLE)), F.lit("] (score: "), plain(d["score"]), F.lit("): "),
        snippet(d["chunk_content"], 200), F.lit("...\n")))
    found = F.concat(F.lit("Found "), F.size(documents).cast("string"), F.lit(" relevant document chunks:\n"),
                     F.array_join(shown, ""))
    return (df.withColumn("sql_evidence", F.when(F.col("sql_row_count").isNotNull(), sql).otherwise("No SQL results."))
            .withColumn("document_evidence", F.when(F.size(documents) > 0, found).otherwise("No document results.")))
