"""Quality measures over search results, answers and routed questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import answers as ans
from ledgerlight.operators import evaluation as ev
from ledgerlight.plans import answers as asked
from ledgerlight.plans import retrieval as found
from ledgerlight.plans.answers import CONF_SQL, PREDICTED_SQL
from ledgerlight.plans.questions import CITED_SQL, QUESTIONS_SQL, cited_answers, questions, responses
from ledgerlight.plans.registry import query

JUDGED_SQL = found.SCORED_SQL + """
, rel AS (SELECT label AS query_id, vec_id AS item_id FROM embeddings),
n_rel AS (SELECT query_id, COUNT(*) AS n_rel FROM rel GROUP BY query_id),
flagged AS (SELECT h.query_id, h.chunk_id AS item_id, h.rank, CASE WHEN r.item_id IS NULL THEN 0 ELSE 1 END AS is_relevant
  FROM hits h LEFT JOIN rel r ON r.query_id = h.query_id AND r.item_id = h.chunk_id),
ks(k) AS (VALUES (1), (3), (5), (10)),
at_k AS (SELECT n.query_id, k, n_rel, SUM(CASE WHEN rank <= k THEN is_relevant ELSE 0 END) AS got,
    SUM(CASE WHEN rank <= k AND is_relevant = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
    list_sum(list_transform(range(1, CAST(least(n_rel, k) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS idcg
  FROM n_rel n CROSS JOIN ks LEFT JOIN flagged f ON f.query_id = n.query_id GROUP BY n.query_id, k, n_rel)
"""


def judged(t):
    """The label questions' hits, and as relevant every vector of the label."""
    hits = found.found(t).withColumnRenamed("chunk_id", "item_id").select("query_id", "item_id", "rank")
    relevant = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"))
    return hits, relevant


@query("jn7_relevance_flags", JUDGED_SQL + "SELECT query_id, item_id, rank, is_relevant FROM flagged")
def flags(t):
    return ev.flag_relevant(*judged(t))


@query("ev1_precision_at_k", JUDGED_SQL + "SELECT query_id, k, ROUND(got / k, 6) AS precision FROM at_k")
def precision(t):
    return ev.precision_at_k(*judged(t)).withColumn("precision", F.round("precision", 6))


@query("ev2_recall_at_k", JUDGED_SQL + "SELECT query_id, k, ROUND(got / n_rel, 6) AS recall FROM at_k")
def recall(t):
    return ev.recall_at_k(*judged(t)).withColumn("recall", F.round("recall", 6))


@query("ev3_ndcg_at_k", JUDGED_SQL + "SELECT query_id, k, ROUND(dcg / idcg, 6) AS ndcg FROM at_k")
def ndcg(t):
    return ev.ndcg_at_k(*judged(t)).withColumn("ndcg", F.round("ndcg", 6))


RANK_SQL = JUDGED_SQL + """
, firsts AS (SELECT n.query_id, MIN(CASE WHEN is_relevant = 1 THEN rank END) AS first FROM n_rel n LEFT JOIN flagged f USING (query_id) GROUP BY n.query_id)
"""


@query("ev4_reciprocal_rank", RANK_SQL + """
SELECT query_id, ROUND(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, ROUND(AVG(coalesce(1.0 / first, 0)) OVER (), 6) AS mrr FROM firsts
""")
def reciprocal(t):
    ranks = ev.rank_metrics(*judged(t)).drop("hit_rate")
    mean = ranks.agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    return ranks.withColumn("mrr", mean.scalar()).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query("ev5_hit_rate", RANK_SQL + """
SELECT query_id, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END AS hit_rate,
  ROUND(AVG(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END) OVER (), 6) AS mean_hit_rate FROM firsts
""")
def hit_rate(t):
    ranks = ev.rank_metrics(*judged(t)).drop("reciprocal_rank")
    return ranks.withColumn("mean_hit_rate", ranks.agg(F.round(F.avg("hit_rate"), 6)).scalar())


@query("ev6_sql_exact_match", r"""
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0.0 ELSE 1.0 END AS exact_match FROM conversations
""")
def exact(t):
    predicted = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.lower("text"), F.lit(" \n"))) \
        .when(F.col("turn") % 3 == 1, F.regexp_replace("text", r"\s+", F.lit(" \n\t"))).otherwise(F.concat("text", F.lit(" x")))
    return t.conversations.select("conv_id", "turn", ev.sql_exact_match(predicted, "text").alias("exact_match"))


@query("ev8_claims", f"""
WITH {CITED_SQL},
pieces AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS c FROM ans)
SELECT conv_id, turn, CAST(unnest(range(len(c))) AS INTEGER) AS claim_index, unnest(c) AS claim FROM pieces
""")
def claim_rows(t):
    return ev.claims(cited_answers(t), keep=("conv_id", "turn"))


@query("ev9_citations_in_text", f"""
WITH {CITED_SQL},
found AS (SELECT conv_id, turn, regexp_extract_all(answer, '\\[source:\\s*(\\w+),\\s*([^\\]]+)\\]', 1) AS k, regexp_extract_all(answer, '\\[source:\\s*(\\w+),\\s*([^\\]]+)\\]', 2) AS i FROM ans)
SELECT conv_id, turn, CAST(unnest(range(len(k))) AS INTEGER) AS citation_index, unnest(k) AS type, unnest(i) AS id FROM found
""")
def citation_rows(t):
    return ev.cited(cited_answers(t), keep=("conv_id", "turn"))


FAITH_SQL = f"""
WITH {CITED_SQL},
cl AS (SELECT *, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '')) AS claim FROM ans),
ci AS (SELECT *, regexp_extract_all(claim, '\\[source:\\s*(\\w+),\\s*([^\\]]+)\\]', 1) AS k, regexp_extract_all(claim, '\\[source:\\s*(\\w+),\\s*([^\\]]+)\\]', 2) AS i FROM cl),
va AS (SELECT conv_id, turn, answer, len(list_filter(range(1, len(k) + 1), lambda j: CASE k[j] WHEN 'sql' THEN has_sql WHEN 'forecast' THEN has_forecast
    WHEN 'document' THEN i[j] = CAST(conv_id AS VARCHAR) OR i[j] = 't' ELSE false END)) AS valid FROM ci),
fa AS (SELECT conv_id, turn, COUNT(*) AS claims_total, SUM(CASE WHEN valid > 0 THEN 1 ELSE 0 END) AS claims_supported,
  len(regexp_extract_all(any_value(answer), '\\[source:\\s*(\\w+),\\s*([^\\]]+)\\]')) AS citations_total, SUM(valid) AS citations_valid
  FROM va GROUP BY conv_id, turn)
"""


@query("ev10_faithfulness", FAITH_SQL + """
SELECT conv_id, turn, CAST(claims_total AS INTEGER) AS claims_total, CAST(claims_supported AS INTEGER) AS claims_supported,
  CAST(citations_total AS INTEGER) AS citations_total, CAST(citations_valid AS INTEGER) AS citations_valid,
  ROUND(claims_supported / claims_total, 6) AS faithfulness_score, ROUND(citations_valid / citations_total, 6) AS citation_precision,
  ROUND(citations_valid / claims_total, 6) AS citation_recall, ROUND(1 - claims_supported / claims_total, 6) AS hallucination_rate
FROM fa
""")
def faithful(t):
    out = ev.faithfulness(cited_answers(t)).drop("answer", "has_sql", "has_financial", "has_forecast", "documents")
    for c in ("faithfulness_score", "citation_precision", "citation_recall", "hallucination_rate"):
        out = out.withColumn(c, F.round(c, 6))
    return out


def results(t):
    """Labels as judged results: some lack a retrieval or a SQL measure."""
    return t.labels.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("quality").cast("double")).alias("hit_rate"),
        F.when(F.col("doc_id") % 2 == 0, 1.0 - F.col("toxic")).alias("execution_accuracy"),
        (F.lit(0.6) + 0.2 * F.col("quality")).alias("faithfulness_score"),
        (F.col("doc_id") % 100).cast("double").alias("latency_ms"), (F.col("quality") * 0.5 + 0.25).alias("confidence"))


RESULTS_SQL = """
WITH res AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(quality AS DOUBLE) END AS hit_rate, CASE WHEN doc_id % 2 = 0 THEN 1.0 - toxic END AS execution_accuracy,
  CAST(0.6 + 0.2 * quality AS DOUBLE) AS faithfulness_score, CAST(doc_id % 100 AS DOUBLE) AS latency_ms, CAST(quality * 0.5 + 0.25 AS DOUBLE) AS confidence FROM labels),
done AS (SELECT *, coalesce(hit_rate >= 0.5, true) AND coalesce(execution_accuracy >= 1, true) AND faithfulness_score >= 0.7 AS passed FROM res)
"""


@query("ev11_pass_flag", RESULTS_SQL + "SELECT doc_id, passed FROM done")
def pass_flag(t):
    return results(t).select("doc_id", ev.passed().alias("passed"))


@query("ag12_evaluation_summary", RESULTS_SQL + """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE passed) AS passed, ROUND(COUNT(*) FILTER (WHERE passed) / COUNT(*), 6) AS pass_rate,
  ROUND(AVG(latency_ms), 6) AS avg_latency_ms, ROUND(AVG(confidence), 6) AS avg_confidence, ROUND(AVG(hit_rate), 6) AS retrieval_hit_rate,
  ROUND(AVG(execution_accuracy), 6) AS sql_execution_accuracy, ROUND(AVG(faithfulness_score), 6) AS answer_faithfulness FROM done
""")
def summary(t):
    out = ev.eval_summary(results(t).withColumn("passed", ev.passed()))
    return out.select("total", "passed", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("total", "passed")])


PAIRS_SQL = f"WITH {QUESTIONS_SQL}, {PREDICTED_SQL}"


@query("jn8_prediction_pairs", PAIRS_SQL + " SELECT id, predicted, truth FROM pred")
def pair_rows(t):
    return asked.pairs(t)


@query("ag13_confusion", PAIRS_SQL + " SELECT truth, predicted, COUNT(*) AS n FROM pred GROUP BY truth, predicted")
def confusion(t):
    return ev.confusion(asked.pairs(t))


CLASSES_SQL = PAIRS_SQL + """,
classes(intent) AS (VALUES ('sql'), ('document'), ('hybrid'), ('clarification'), ('financial_model'), ('forecast'), ('schedule_report')),
cm AS (SELECT c.intent, COUNT(*) FILTER (WHERE predicted = c.intent AND truth = c.intent) AS tp,
  COUNT(*) FILTER (WHERE predicted = c.intent AND truth <> c.intent) AS fp, COUNT(*) FILTER (WHERE predicted <> c.intent AND truth = c.intent) AS fn
  FROM classes c CROSS JOIN pred GROUP BY c.intent),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cm),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)
"""


@query("ag14_class_metrics", CLASSES_SQL + """
SELECT intent, tp, fp, fn, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1 FROM f
""")
def classes(t):
    out = ev.class_metrics(asked.pairs(t))
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("ag15_macro_f1", CLASSES_SQL + "SELECT ROUND(AVG(f1), 6) AS macro_f1 FROM f")
def macro(t):
    return ev.macro_f1(asked.pairs(t)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("ag16_tool_selection", PAIRS_SQL + """
SELECT ROUND(AVG(CASE WHEN predicted = truth THEN 1.0 ELSE 0 END), 6) AS accuracy,
  ROUND(coalesce(AVG(CASE WHEN predicted IN ('sql', 'hybrid') THEN 1.0 ELSE 0 END) FILTER (WHERE truth IN ('sql', 'hybrid')), 1), 6) AS sql_vs_rag_correct,
  ROUND(coalesce(AVG(CASE WHEN predicted = truth THEN 1.0 ELSE 0 END) FILTER (WHERE truth = 'hybrid'), 1), 6) AS hybrid_routing_correct,
  ROUND(coalesce(AVG(CASE WHEN predicted = truth THEN 1.0 ELSE 0 END) FILTER (WHERE truth = 'financial_model'), 1), 6) AS financial_model_correct,
  ROUND(coalesce(AVG(CASE WHEN predicted = truth THEN 1.0 ELSE 0 END) FILTER (WHERE truth = 'forecast'), 1), 6) AS forecast_correct,
  ROUND(coalesce(AVG(CASE WHEN predicted = truth THEN 1.0 ELSE 0 END) FILTER (WHERE truth = 'schedule_report'), 1), 6) AS schedule_correct
FROM pred
""")
def tools(t):
    out = ev.tool_selection(asked.pairs(t))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("ev12_evaluation_job")
def job(t):
    """Each assistant answer is judged against the document numbered like its conversation."""
    answers = cited_answers(t).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    questions = answers.select("id", F.col("answer").alias("question"), F.lit("hybrid").alias("intent"),
                               F.array(F.col("conv_id").cast("string")).alias("relevant_doc_ids"))
    responses = (answers.withColumn("intent", F.lit("hybrid")).withColumn("latency_ms", F.char_length("answer").cast("double"))
                 .withColumn("confidence", F.lit(0.5)).drop("conv_id", "turn"))
    hits = answers.select(F.col("id").alias("query_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("turn").cast("string").alias("item_id")),
        F.struct(F.lit(2).alias("rank"), F.col("conv_id").cast("string").alias("item_id")))).alias("h")).select("query_id", "h.*")
    out = ev.evaluate(questions, responses, hits)
    return ev.eval_summary(out)


HITS_SQL = found.SCORED_SQL.replace("WITH parts AS", ", components AS").replace("FROM parts", "FROM components")


@query("ev12_evaluation_of_hits", CONF_SQL + HITS_SQL + f"""
, {QUESTIONS_SQL}, {PREDICTED_SQL},
lowest AS (SELECT label, MIN(vec_id) AS v FROM embeddings GROUP BY label),
hit AS (SELECT l.label, MAX(CASE WHEN h.chunk_id = l.v THEN 1.0 ELSE 0.0 END) AS hit_rate FROM lowest l JOIN hits h ON h.query_id = l.label GROUP BY l.label),
res AS (SELECT c.value AS latency_ms, c.confidence, p.truth = p.predicted AS routed, hit.hit_rate,
    (CASE WHEN c.sql_row_count IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c.has_docs THEN 1 ELSE 0 END) / 2.0 AS faith
  FROM pred p JOIN conf c ON c.event_id = p.id LEFT JOIN hit ON hit.label = p.id)
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE ok) AS passed, ROUND(AVG(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS pass_rate,
  ROUND(AVG(latency_ms), 2) AS avg_latency_ms, ROUND(AVG(confidence), 6) AS avg_confidence, ROUND(AVG(hit_rate), 6) AS retrieval_hit_rate,
  CAST(NULL AS DOUBLE) AS sql_execution_accuracy, ROUND(AVG(faith), 6) AS answer_faithfulness, ROUND(AVG(CASE WHEN routed THEN 1.0 ELSE 0 END), 6) AS routing_accuracy
FROM (SELECT *, coalesce(hit_rate, 0.5) >= 0.5 AND faith >= 0.7 AS ok FROM res)
""")
def job_over_hits(t):
    """Questions with their stated intent; intents by the rules, hits by vector search, confidence from the parts of a response.

    The question numbered like a label has that label's first vector as relevant. Every answer makes two claims, one from
    a table and one from a document, which hold if the response has these parts.
    """
    number = F.col("id").cast("string")
    lowest = t.embeddings.groupBy(F.col("label").alias("id")).agg(F.array(F.min("vec_id").cast("string")).alias("relevant_doc_ids"))
    stated = questions(t).join(lowest, "id", "left").select(
        number.alias("id"), "question", "intent", F.coalesce("relevant_doc_ids", F.array().cast("array<string>")).alias("relevant_doc_ids"))
    routed = asked.predicted(t).select(F.col("id").alias("event_id"), "intent")
    claims = F.concat(F.lit("Seen in "), F.col("event_type"), F.lit(" [source: sql, q]. As written [source: document, "),
                      F.col("user_id").cast("string"), F.lit("]!"))
    given = ans.with_confidence(responses(t)).join(routed, "event_id").select(
        F.col("event_id").cast("string").alias("id"), "intent", claims.alias("answer"), F.col("value").alias("latency_ms"), "confidence",
        F.col("sql_row_count").isNotNull().alias("has_sql"), "has_financial", "has_forecast", "documents")
    hits = found.found(t).select(F.col("query_id").cast("string").alias("query_id"), F.col("chunk_id").cast("string").alias("item_id"), "rank")
    judged_rows = ev.evaluate(stated, given, hits)
    routing = judged_rows.agg(F.round(F.avg((F.col("predicted") == F.col("truth")).cast("int")), 6).alias("routing_accuracy"))
    summary = ev.eval_summary(judged_rows)
    six = ["pass_rate", "avg_confidence", "retrieval_hit_rate", "answer_faithfulness"]
    return summary.select("total", "passed", *[F.round(c, 6).alias(c) for c in six], F.round("avg_latency_ms", 2).alias("avg_latency_ms"),
                          "sql_execution_accuracy", routing.scalar().alias("routing_accuracy"))
