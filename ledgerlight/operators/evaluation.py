"""Quality measures for retrieval, SQL, answers and routing, over whole result tables."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from math import log2

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import text as tx
from ledgerlight.operators.guard import GuardError, guarded_query

K_VALUES = (1, 3, 5, 10)
MIN_HIT_RATE = 0.5
MIN_EXECUTION_ACCURACY = 1.0
MIN_FAITHFULNESS = 0.7
INTENTS = ("sql", "document", "hybrid", "clarification", "financial_model", "forecast", "schedule_report")
CITATION = r"\[source:\s*(\w+),\s*([^\]]+)\]"


def flag_relevant(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hits with ``is_relevant`` 0/1; both sides keyed by (query_id, item_id)."""
    marks = relevant.select("query_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    return hits.join(marks, ["query_id", "item_id"], "left").select(
        *hits.columns, F.coalesce("_hit", F.lit(0)).alias("is_relevant"))


def _per_query(hits: DataFrame, relevant: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per query: counts and gains at each k, first relevant rank, relevant total."""
    flagged = flag_relevant(hits, relevant)
    rel = F.col("is_relevant") == 1
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    sums = []
    for k in ks:
        inside = rel & (F.col("rank") <= k)
        sums += [F.count_if(inside).alias(f"_hits_{k}"), F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"_dcg_{k}")]
    per_hit = flagged.groupBy("query_id").agg(*sums, F.min(F.when(rel, F.col("rank"))).alias("_first"))
    totals = relevant.select("query_id", "item_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("_n_rel"))
    return per_hit.join(totals, "query_id", "full").fillna(0, [c for c in per_hit.columns if c.startswith(("_hits", "_dcg"))]) \
        .fillna(0, ["_n_rel"])


def retrieval_at_k(hits: DataFrame, relevant: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """Long rows (query_id, k, precision, recall, ndcg)."""
    rows = []
    for k in ks:
        ideal = [0.0]
        for i in range(k):
            ideal.append(ideal[-1] + 1.0 / log2(i + 2))
        best = F.element_at(F.array(*[F.lit(v) for v in ideal]), F.least(F.col("_n_rel"), F.lit(k)).cast("int") + 1)
        rows.append(F.struct(
            F.lit(k).alias("k"),
            (F.col(f"_hits_{k}") / F.lit(k)).alias("precision"),
            F.when(F.col("_n_rel") > 0, F.col(f"_hits_{k}") / F.col("_n_rel")).otherwise(0.0).alias("recall"),
            F.when(best > 0, F.col(f"_dcg_{k}") / best).otherwise(0.0).alias("ndcg")))
    return _per_query(hits, relevant, ks).select("query_id", F.explode(F.array(*rows)).alias("m")).select("query_id", "m.*")


def precision_at_k(hits: DataFrame, relevant: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    return retrieval_at_k(hits, relevant, ks).select("query_id", "k", "precision")


def recall_at_k(hits: DataFrame, relevant: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    return retrieval_at_k(hits, relevant, ks).select("query_id", "k", "recall")


def ndcg_at_k(hits: DataFrame, relevant: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    return retrieval_at_k(hits, relevant, ks).select("query_id", "k", "ndcg")


def rank_metrics(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, reciprocal_rank, hit_rate), both 0 when nothing relevant came back."""
    first = F.col("_first")
    return _per_query(hits, relevant, ()).select(
        "query_id", F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"),
        F.when(first.isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"))


def sql_exact_match(predicted: Column | str, expected: Column | str) -> Column:
    return F.when(tx.collapse(predicted) == tx.collapse(expected), 1.0).otherwise(0.0)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same set of rows; names, order and repeats do not count."""
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    names = [f"c{i}" for i in range(len(a.columns))]

    def as_text(df: DataFrame) -> DataFrame:
        df = df.toDF(*names)
        return df.select(*[F.col(n).cast("string").alias(n) for n in names]).distinct()

    left, right = as_text(a).withColumn("_l", F.lit(1)), as_text(b).withColumn("_r", F.lit(1))
    marked = (left.select(*names, "_l", F.lit(0).alias("_r"))
              .unionByName(right.select(*names, F.lit(0).alias("_l"), "_r"))
              .groupBy(*names).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")))
    return marked.where(F.col("_l") != F.col("_r")).isEmpty()


def sql_execution_match(spark: SparkSession, pairs: Sequence[tuple[object, str, str]],
                        sources: Mapping[str, str]) -> DataFrame:
    """(id, valid, execution_accuracy, exact_match, avg_execution_time_ms) per pair of queries.

    One comparison per labelled question; both results are compared inside Spark and never
    brought to the driver.
    """
    rows = []
    for key, predicted, expected in pairs:
        exact = 1.0 if " ".join(predicted.split()).lower() == " ".join(expected.split()).lower() else 0.0
        try:
            start = time.perf_counter()
            got = guarded_query(spark, predicted, sources)
            want = guarded_query(spark, expected, sources)
            equal = same_rows(got, want)
            spent = (time.perf_counter() - start) * 1000 / 2
            rows.append((str(key), 1.0, 1.0 if equal else 0.0, exact, spent))
        except (GuardError, AnalysisException):  # a fault of the cluster is no wrong answer
            rows.append((str(key), 0.0, 0.0, exact, 0.0))
    return spark.createDataFrame(
        rows, "id string, valid_sql_rate double, execution_accuracy double, exact_match_accuracy double, "
              "avg_execution_time_ms double")


def claims_array(answer: Column | str) -> Column:
    """Trimmed non-empty pieces between full stops, exclamation and question marks.

    Decimal points split too, as the rule is stated.
    """
    c = F.col(answer) if isinstance(answer, str) else answer
    return F.filter(F.transform(F.split(c, "[.!?]+"), tx.strip), lambda x: x != "")


def claims(df: DataFrame, answer: str = "answer", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.posexplode(claims_array(answer)).alias("claim_index", "claim"))


def citations_array(text: Column | str) -> Column:
    """Array of structs (type, id) cited in the text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.zip_with(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)),
                      F.regexp_extract_all(c, F.lit(CITATION), F.lit(2)),
                      lambda kind, key: F.struct(kind.alias("type"), key.alias("id")))


def cited(df: DataFrame, answer: str = "answer", keep: Sequence[str] = ()) -> DataFrame:
    return (df.select(*keep, F.posexplode(citations_array(answer)).alias("citation_index", "c"))
            .select(*keep, "citation_index", "c.type", "c.id"))


def faithfulness(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds claim and citation counts and the scores built from them; no shuffle.

    Needs ``has_sql``, ``has_financial``, ``has_forecast`` and ``documents``, an array of
    structs (document_id, title) cut to the answer's hits.
    """
    named = F.transform("documents", lambda d: F.struct(d["document_id"].cast("string").alias("document_id"), d["title"].alias("title")))
    documents = F.coalesce(named, F.array().cast("array<struct<document_id:string,title:string>>"))

    def valid(citation: Column) -> Column:
        kind, key = citation["type"], citation["id"]
        in_documents = F.exists(documents, lambda d: (d["document_id"] == key) | (d["title"] == key))
        return F.coalesce(
            F.when(kind == "document", in_documents)
            .when(kind == "sql", F.col("has_sql"))
            .when(kind == "financial", F.col("has_financial"))
            .when(kind == "forecast", F.col("has_forecast")), F.lit(False))

    per_claim = F.transform(claims_array(answer), lambda c: F.size(F.filter(citations_array(c), valid)))
    counted = (df.withColumn("_valid", per_claim)
               .withColumn("claims_total", F.size("_valid"))
               .withColumn("claims_supported", F.size(F.filter("_valid", lambda n: n > 0)))
               .withColumn("citations_total", F.size(citations_array(answer)))
               .withColumn("citations_valid", F.aggregate("_valid", F.lit(0), lambda a, n: a + n)))
    n_claims, n_cited = F.col("claims_total"), F.col("citations_total")
    score = F.when(n_claims > 0, F.col("claims_supported") / n_claims).otherwise(1.0)
    return (counted.drop("_valid")
            .withColumn("faithfulness_score", score)
            .withColumn("citation_precision", F.when(n_cited > 0, F.col("citations_valid") / n_cited).otherwise(1.0))
            .withColumn("citation_recall", F.when(n_claims > 0, F.col("citations_valid") / n_claims).otherwise(1.0))
            .withColumn("hallucination_rate", 1.0 - score))


def passed(hit_rate: str = "hit_rate", execution: str = "execution_accuracy", faithful: str = "faithfulness_score") -> Column:
    """Whether every measure that is present reaches its threshold."""
    return ((F.coalesce(F.col(hit_rate), F.lit(MIN_HIT_RATE)) >= MIN_HIT_RATE)
            & (F.coalesce(F.col(execution), F.lit(MIN_EXECUTION_ACCURACY)) >= MIN_EXECUTION_ACCURACY)
            & (F.coalesce(F.col(faithful), F.lit(MIN_FAITHFULNESS)) >= MIN_FAITHFULNESS))


def eval_summary(results: DataFrame) -> DataFrame:
    """One row over all results; measures a result lacks do not count."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("hit_rate").alias("retrieval_hit_rate"),
        F.avg("execution_accuracy").alias("sql_execution_accuracy"),
        F.avg("faithfulness_score").alias("answer_faithfulness"))


def pair_intents(predictions: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Predictions beside truth by id; rows only one side has raise when the pairs are used."""
    both = predictions.select(key, F.col("intent").alias("predicted"), F.lit(True).alias("_p")).join(
        truth.select(key, F.col("intent").alias("truth"), F.lit(True).alias("_t")), key, "full")
    missing = F.col("_p").isNull() | F.col("_t").isNull()
    check = F.when(missing, F.raise_error(F.lit("predictions and truth must cover the same ids")).cast("string"))
    return both.select(key, F.coalesce(check, F.col("predicted")).alias("predicted"), "truth")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(pairs: DataFrame, classes: Sequence[str] = INTENTS) -> DataFrame:
    return pairs.groupBy("truth").pivot("predicted", list(classes)).agg(F.count(F.lit(1))).fillna(0)


def class_metrics(pairs: DataFrame, classes: Sequence[str] = INTENTS) -> DataFrame:
    """Precision, recall and F1 of every class, those never seen included.

    One aggregate over the pairs; the classes are unfolded from its single row.
    """
    p, t = F.col("predicted"), F.col("truth")
    sums = []
    for i, name in enumerate(classes):
        sums += [F.count_if((p == name) & (t == name)).alias(f"tp{i}"),
                 F.count_if((p == name) & (t != name)).alias(f"fp{i}"),
                 F.count_if((p != name) & (t == name)).alias(f"fn{i}")]
    rows = [F.struct(F.lit(name).alias("intent"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                     F.col(f"fn{i}").alias("fn")) for i, name in enumerate(classes)]
    long = pairs.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (long.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.count_if(F.col("predicted") == F.col("truth")) / F.nullif(F.count(F.lit(1)), F.lit(0)),
                                F.lit(0.0)).alias("accuracy"))


def macro_f1(pairs: DataFrame, classes: Sequence[str] = INTENTS) -> DataFrame:
    return class_metrics(pairs, classes).agg(F.avg("f1").alias("macro_f1"))


def tool_selection(pairs: DataFrame) -> DataFrame:
    """Routing accuracy overall and by family; a family no question belongs to counts as right."""
    p, t = F.col("predicted"), F.col("truth")
    n = F.count(F.lit(1))

    def share(right: Column, asked: Column) -> Column:
        rate = F.coalesce(F.count_if(asked & right) / F.nullif(F.count_if(asked), F.lit(0)), F.lit(1.0))
        return F.when(n > 0, rate).otherwise(0.0)

    family = ("sql", "hybrid")
    return pairs.agg(
        share(p == t, F.lit(True)).alias("accuracy"),
        share(p.isin(*family), t.isin(*family)).alias("sql_vs_rag_correct"),
        share(p == "hybrid", t == "hybrid").alias("hybrid_routing_correct"),
        share(p == "financial_model", t == "financial_model").alias("financial_model_correct"),
        share(p == "forecast", t == "forecast").alias("forecast_correct"),
        share(p == "schedule_report", t == "schedule_report").alias("schedule_correct"))


def evaluate(questions: DataFrame, responses: DataFrame, hits: DataFrame, sql_checks: DataFrame | None = None) -> DataFrame:
    """One result row per question.

    ``questions`` has id, question, intent and relevant_doc_ids; ``responses`` has id, intent,
    answer, latency_ms, confidence, the has_* flags and documents; ``hits`` has query_id,
    item_id and rank; ``sql_checks`` has id and execution_accuracy.
    """
    relevant = questions.select(F.col("id").alias("query_id"), F.explode("relevant_doc_ids").alias("item_id"))
    # Retrieval counts only where something was relevant and something came back.
    asked = hits.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    ranks = rank_metrics(asked, relevant.join(asked.select("query_id").distinct(), "query_id", "left_semi"))
    scored = faithfulness(responses).drop("documents", "has_sql", "has_financial", "has_forecast")
    out = (questions.select("id", "question", F.col("intent").alias("truth"))
           .join(scored.withColumnRenamed("intent", "predicted").drop("question"), "id")
           .join(ranks.withColumnRenamed("query_id", "id"), "id", "left"))
    if sql_checks is None:
        out = out.withColumn("execution_accuracy", F.lit(None).cast("double"))
    else:
        out = out.join(sql_checks.select("id", "execution_accuracy"), "id", "left")
    return out.withColumn("passed", passed())
