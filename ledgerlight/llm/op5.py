"""op5: how likely every document's words are after one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.lm_score import score
from ledgerlight.llm.registry import query, table

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
           FROM documents),
g AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
ones AS (SELECT b AS word, count(*) AS n FROM g GROUP BY b),
twos AS (SELECT a, b, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b),
p AS (SELECT g.doc_id, CASE WHEN twos.n >= 2 THEN ln(twos.n / ctx.n)
                            ELSE ln(ones.n / (SELECT count(*) FROM g)) + CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END END AS s
      FROM g JOIN ones ON g.b = ones.word LEFT JOIN twos ON g.a = twos.a AND g.b = twos.b LEFT JOIN ones ctx ON g.a = ctx.word),
sums AS (SELECT doc_id, avg(s) AS score FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(score, 6) AS score FROM d LEFT JOIN sums USING (doc_id)
"""


@query("op5_lm_scoring", SQL)
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents")).select("doc_id", "n_words", F.round("score", 6).alias("score"))
