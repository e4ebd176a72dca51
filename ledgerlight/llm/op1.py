"""op1: every page's URL judged by stated and mined rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm.registry import query, table
from ledgerlight.llm.url_rules import judge

#: (verdict, host, start of the path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
u AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS args FROM p),
t AS (SELECT *, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(
        ['h:' || x FOR x IN string_split(host, '.') IF x <> ''] ||
        ['p:' || x FOR x IN string_split({_LOWER.format("path")}, '/') IF x <> ''] ||
        ['q:' || split_part(x, '=', 1) FOR x IN string_split(args, '&') IF split_part(x, '=', 1) <> ''])) END AS tokens FROM u),
bad AS (SELECT doc_id, max(CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INT)) AS bad FROM labels
        WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT tokens, bad FROM t JOIN bad ON page_id = doc_id WHERE len(tokens) > 0),
ones AS (SELECT row_number() OVER () AS r, tokens, bad FROM l),
e AS (SELECT r, bad, unnest(tokens) AS x FROM ones),
sets AS (
  SELECT [x] AS s, bad FROM e
  UNION ALL SELECT [a.x, b.x], a.bad FROM e a JOIN e b ON a.r = b.r AND a.x < b.x
  UNION ALL SELECT [a.x, b.x, c.x], a.bad FROM e a JOIN e b ON a.r = b.r AND a.x < b.x JOIN e c ON a.r = c.r AND b.x < c.x),
rules AS (SELECT s FROM sets GROUP BY s
          HAVING sum(bad) >= greatest(5, ceil(0.002 * (SELECT count(*) FROM l))) AND sum(bad) >= 0.6 * count(*)),
mined AS (SELECT DISTINCT url FROM t, rules WHERE list_has_all(tokens, s)),
stated(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                                 ('allow', 'org', '/fr/')),
fits AS (SELECT host AS fh, path AS fp, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
         FROM (SELECT DISTINCT host, path FROM u), stated
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN url IN (SELECT url FROM mined) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits ON host = fh AND path = fp
"""


@query("op1_url_filters", SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), table(spark, folder, "labels"), RULES)
