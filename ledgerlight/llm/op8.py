"""op8: the ten documents most like every fiftieth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.bm25 import top_documents
from ledgerlight.llm.registry import query, table

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
tf AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
r AS (SELECT q.doc_id AS query_id, tf.doc_id,
             round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.len / mean))), 6) AS score
      FROM tf q JOIN tf ON q.t = tf.t JOIN df ON df.t = q.t, s WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, tf.doc_id),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
      FROM r)
SELECT * FROM k WHERE rank <= 10
"""


@query("op8_topk_search", SQL)
def search(spark: SparkSession, folder: str) -> DataFrame:
    return top_documents(table(spark, folder, "documents"), F.col("doc_id") % 50 == 0)
