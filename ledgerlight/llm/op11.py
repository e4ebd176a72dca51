"""op11: every document's proof of membership in a hash tree of the table, and whether a changed one is found out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.merkle import digest, fold, leaf_hash, manifest, siblings
from ledgerlight.llm.registry import query, table

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN 1 ELSE list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) END AS crc,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS f1,
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS f2,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS f4
  FROM documents),
l AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS tree,
    sha256(f1 || f2 || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || f4) AS leaf,
    sha256(f1 || f2 || coalesce(strlen(CAST(n_chars + t AS VARCHAR)) || ':' || (n_chars + t), '-') || f4) AS tampered
  FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(crc, CAST(4294967295 AS BIGINT)) % 7 = 0 THEN 1 ELSE 0 END AS t FROM d)),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes(level, tree, pos, n, h) AS (
  SELECT 0, tree, pos, n, leaf FROM p
  UNION ALL
  SELECT level + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY level, tree, pos // 2, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
             FROM nodes WHERE n = 1),
tops(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1
  GROUP BY level, pos // 2, n),
up AS (
  SELECT a.level, a.tree, a.pos, a.n, coalesce(b.h, '') AS sib, a.pos % 2 AS side
  FROM nodes a LEFT JOIN nodes b ON a.level = b.level AND a.tree = b.tree AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT 1000 + a.level, '', a.pos, a.n, coalesce(b.h, ''), a.pos % 2
  FROM tops a LEFT JOIN tops b ON a.level = b.level AND b.pos = xor(a.pos, 1)),
walk(id, leaf, level, tree, pos, proof, node, subroot) AS (
  SELECT p.doc_id, p.leaf, 0, p.tree, p.pos, '', p.tampered, s.subroot FROM p JOIN subroots s USING (tree)
  UNION ALL
  SELECT w.id, w.leaf, CASE WHEN up.n > 1 THEN w.level + 1 ELSE 1000 END, CASE WHEN up.n > 1 THEN w.tree ELSE '' END,
    CASE WHEN up.n > 1 THEN w.pos // 2 ELSE s.pos END, w.proof || up.sib,
    CASE WHEN up.n = 1 THEN w.node WHEN up.side = 1 THEN sha256(up.sib || w.node) ELSE sha256(w.node || up.sib) END, w.subroot
  FROM walk w JOIN up ON up.level = w.level AND up.tree = w.tree AND up.pos = w.pos LEFT JOIN subroots s ON s.tree = w.tree
  WHERE NOT (up.n = 1 AND w.level >= 1000)),
ends AS (SELECT max(level) + 1000 AS level FROM tops)
SELECT w.id AS doc_id, w.leaf, w.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root,
  w.node = r.h AS verified
FROM walk w JOIN ends USING (level) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
"""


@query("op11_merkle_manifest", SQL)
def merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    columns = [F.col(c) for c in names]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]
    keep = {"doc_id": F.col("doc_id"), "found": F.when(tampered, leaf_hash(changed)).otherwise(leaf_hash(columns))}
    proved = manifest(docs, columns, F.col("lang"), F.col("doc_id"), keep)
    folded = proved.withColumn("folded_root", fold(F.col("row.found"), F.col("path")))
    return folded.select("row.doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
