"""op4: documents without chunks of lines that stand earlier in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.line_chunks import drop_repeated
from ledgerlight.llm.registry import query, table

SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM d),
k AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM h),
c AS (SELECT *, i > 1 AND (v + 31 * lag(v) OVER w) % 3 = 0 AS cand FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i < n AND cand AND NOT coalesce(lag(cand) OVER (PARTITION BY doc_id ORDER BY i), false) AS ends FROM c),
p AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS chunk FROM e),
q AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM p GROUP BY doc_id, chunk),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, chunk) > 1 AS gone FROM q)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


@query("op4_line_dedup", SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = drop_repeated(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
