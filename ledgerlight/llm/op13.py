"""op13: groups of documents whose fingerprints differ in at most three bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.registry import query, table
from ledgerlight.llm.simhash import near_fingerprints

# The five primes of XXH64, and the seed.
P1, P2, P3, P4, P5 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED, M = 42, 1 << 64


def _mul(a: str, b: str | int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % CAST({M} AS UHUGEINT) AS UBIGINT)"


def _add(a: str, b: str | int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % CAST({M} AS UHUGEINT) AS UBIGINT)"


def _turn(value: str, by: int) -> str:
    """The 64 bits turned left; the value is bound once."""
    return f"[{_mul('t', 1 << by)} + (t >> {64 - by}) FOR t IN [{value}]][1]"


def _round(acc: str, lane: str) -> str:
    return _mul(_turn(_add(acc, _mul(lane, P2)), 31), P1)


def _lanes(first: str, last: str, step: int = 1) -> str:
    """Eight bytes each, little end first: ``r`` has the bytes of the shingle in reverse."""
    return f"[CAST('0x' || substr(r, CAST(2 * (n - 8 * j - 8) + 1 AS BIGINT), 16) AS UBIGINT) FOR j IN range({first}, {last}, {step})]"


def _fold(start: str, values: str, step: str) -> str:
    """``step`` over ``h`` and ``k``, from ``start`` through the list ``values``."""
    return f"list_reduce(list_prepend(CAST({start} AS UBIGINT), {values}), lambda h, k: {step})"


def _merged(h: str, v: str) -> str:
    return _add(_mul(f"xor({h}, {_round('0', v)})", P1), P4)


# XXH64 step by step: stripes of 32 bytes, lanes of eight, four bytes, single bytes, and the last mixing.
HASH_SQL = f"""
b AS (SELECT s, CAST(octet_length(encode(s)) AS BIGINT) AS n, regexp_replace(reverse(hex(encode(s))), '(.)(.)', '\\2\\1', 'g') AS r FROM (SELECT DISTINCT s FROM g)),
v AS (SELECT *, {", ".join(f"CASE WHEN n >= 32 THEN {_fold(str(start % M), _lanes(str(i), '4 * (n // 32)', 4), _round('h', 'k'))} END AS v{i}"
      for i, start in enumerate((SEED + P1 + P2, SEED + P2, SEED, SEED - P1)))} FROM b),
m0 AS (SELECT *, CASE WHEN n >= 32 THEN {_add(_add(_turn('v0', 1), _turn('v1', 7)), _add(_turn('v2', 12), _turn('v3', 18)))} END AS a FROM v),
m1 AS (SELECT *, {_merged('a', 'v0')} AS a1 FROM m0), m2 AS (SELECT *, {_merged('a1', 'v1')} AS a2 FROM m1),
m3 AS (SELECT *, {_merged('a2', 'v2')} AS a3 FROM m2),
m4 AS (SELECT *, {_add(f"coalesce({_merged('a3', 'v3')}, CAST({SEED + P5} AS UBIGINT))", 'n')} AS a4 FROM m3),
e AS (SELECT *, {_fold('a4', _lanes('4 * (n // 32)', 'n // 8'), _add(_mul(_turn(f"xor(h, {_round('0', 'k')})", 27), P1), P4))} AS a5 FROM m4),
f AS (SELECT *, CASE WHEN n % 8 < 4 THEN a5 ELSE {_add(_mul(_turn(
    "xor(a5, " + _mul("CAST('0x' || substr(r, CAST(2 * (n - 8 * (n // 8) - 4) + 1 AS BIGINT), 8) AS UBIGINT)", P1) + ")", 23), P2), P3)} END AS a6 FROM e),
t AS (SELECT *, {_fold('a6', "[CAST('0x' || substr(r, CAST(2 * (n - o - 1) + 1 AS BIGINT), 2) AS UBIGINT) FOR o IN range(n - n % 4, n)]",
                       _mul(_turn(f"xor(h, {_mul('k', P5)})", 11), P1))} AS a7 FROM f),
x AS (SELECT s, {_mul('xor(a7, a7 >> 33)', P2)} AS a8 FROM t), y AS (SELECT s, {_mul('xor(a8, a8 >> 29)', P3)} AS a9 FROM x),
hashed AS (SELECT s, xor(a9, a9 >> 32) AS h FROM y)"""

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM d),""" + HASH_SQL + f""",
counted AS (SELECT doc_id, COUNT(*) AS n, {", ".join(f"SUM(CAST((h >> {k}) & 1 AS BIGINT)) AS c{k}" for k in range(64))}
  FROM g JOIN hashed USING (s) GROUP BY doc_id),
prints AS (SELECT d.doc_id, coalesce({" + ".join(f"CASE WHEN 2 * c{k} > n THEN CAST({1 << k} AS UBIGINT) ELSE 0 END" for k in range(64))}, 0)::UBIGINT AS fp
  FROM d LEFT JOIN counted USING (doc_id)),
one AS (SELECT fp, MIN(doc_id) AS first FROM prints GROUP BY fp),
links AS (SELECT a.fp AS p, b.fp AS q FROM one a JOIN one b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3),
reach(fp, root) AS (
  SELECT fp, first FROM one UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.fp JOIN one o ON o.fp = l.q AND r.root < o.first)
SELECT p.doc_id, lower(lpad(hex(p.fp), 16, '0')) AS fingerprint, r.root AS component_id
FROM prints p JOIN (SELECT fp, MIN(root) AS root FROM reach GROUP BY fp) r USING (fp)
"""


@query("op13_simhash_near_dedup", SQL)
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_fingerprints(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("finger"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"))
