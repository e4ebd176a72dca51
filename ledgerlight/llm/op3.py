"""op3: groups of documents linked by equal three-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm.jaccard import near_groups
from ledgerlight.llm.registry import query, table

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
f AS (SELECT e.doc_id, g, n FROM e JOIN n USING (doc_id)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y
          FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n
          HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT p.y, r.root FROM r JOIN pairs p ON p.x = r.doc_id AND r.root < p.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""


@query("op3_ngram_jaccard_join", SQL)
def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")
