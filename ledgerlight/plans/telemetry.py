"""Telemetry, audit, history, rate limits and reports, with the events as their log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import maps
from ledgerlight.operators import audit, pages, rate_limit as limits, reports, telemetry as tel
from ledgerlight.plans.answers import CONF_SQL, with_texts
from ledgerlight.plans.registry import query
from ledgerlight.streaming import jobs, ordered

LOG_SQL = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT event_id, ts, user_id, event_type AS operation, value AS latency_ms, k + 10 AS total_tokens, k AS rows_returned,
  CASE WHEN event_type = 'error' AND k >= 50 THEN 'timeout' WHEN event_type = 'error' OR k < 5 THEN 'error' ELSE 'success' END AS status FROM k)
"""


def as_log(events):
    k = maps.json_field("props", "$.k", "int")
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("operation"), F.col("value").alias("latency_ms"),
        (k + 10).alias("total_tokens"), k.alias("rows_returned"),
        F.when(failed & (k >= 50), "timeout").when(failed | (k < 5), "error").otherwise("success").alias("status"))


def log(t):
    return as_log(t.events)


@query("ag7_llm_metrics", f"""
WITH {LOG_SQL}
SELECT operation, COUNT(*) AS calls, CAST(SUM(total_tokens) AS BIGINT) AS tokens, ROUND(SUM(latency_ms), 2) AS latency_ms,
  COUNT(*) FILTER (WHERE status = 'error') AS errors FROM log GROUP BY ROLLUP (operation)
""")
def llm(t):
    return tel.llm_metrics(log(t)).withColumn("latency_ms", F.round("latency_ms", 2))


SQL_AREA = "operation IN ('purchase', 'error')"


@query("ag8_sql_metrics", f"""
WITH {LOG_SQL}
SELECT COUNT(*) AS total_executions, ROUND(SUM(latency_ms), 2) AS total_latency_ms, CAST(SUM(rows_returned) AS BIGINT) AS total_rows,
  COUNT(*) FILTER (WHERE status = 'error') AS errors, COUNT(*) FILTER (WHERE status = 'timeout') AS timeouts FROM log WHERE {SQL_AREA}
""")
def sql(t):
    return tel.sql_metrics(log(t).where(SQL_AREA)).withColumn("total_latency_ms", F.round("total_latency_ms", 2))


def searches(t):
    return log(t).where("operation = 'view'").withColumnRenamed("rows_returned", "results_count")


@query("ag9_retrieval_metrics", f"""
WITH {LOG_SQL}
SELECT COUNT(*) AS total_searches, ROUND(SUM(latency_ms), 2) AS total_latency_ms, CAST(SUM(rows_returned) AS BIGINT) AS total_results
FROM log WHERE operation = 'view'
""")
def searched(t):
    return tel.retrieval_metrics(searches(t)).withColumn("total_latency_ms", F.round("total_latency_ms", 2))


def _percentile_sql(p: float) -> str:
    return f"list(latency_ms ORDER BY latency_ms)[CAST(least(floor(COUNT(*) * CAST({p} AS DOUBLE)), COUNT(*) - 1) AS BIGINT) + 1]"


REQUEST_SQL = f"COUNT(*) AS count, ROUND(AVG(latency_ms), 6) AS avg_ms, {_percentile_sql(0.5)} AS p50_ms, {_percentile_sql(0.95)} AS p95_ms, {_percentile_sql(0.99)} AS p99_ms"


@query("ag10_request_metrics", f"WITH {LOG_SQL} SELECT {REQUEST_SQL} FROM log")
def requests(t):
    return tel.request_metrics(log(t)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("ag10_request_metrics_by_operation", f"WITH {LOG_SQL} SELECT operation, {REQUEST_SQL} FROM log GROUP BY operation")
def requests_by(t):
    return tel.request_metrics(log(t), ["operation"]).withColumn("avg_ms", F.round("avg_ms", 6))


@query("ag11_metrics_summary", f"""
WITH {LOG_SQL}, req AS (SELECT {REQUEST_SQL} FROM log)
SELECT area, metric, ROUND(value, 2) AS value FROM (
  SELECT 'llm' AS area, 'total_calls' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM log
  UNION ALL SELECT 'llm', 'total_tokens', SUM(total_tokens) FROM log
  UNION ALL SELECT 'llm', 'total_latency_ms', SUM(latency_ms) FROM log
  UNION ALL SELECT 'llm', 'errors', COUNT(*) FILTER (WHERE status = 'error') FROM log
  UNION ALL SELECT 'sql', 'total_executions', COUNT(*) FROM log WHERE {SQL_AREA}
  UNION ALL SELECT 'sql', 'total_latency_ms', SUM(latency_ms) FROM log WHERE {SQL_AREA}
  UNION ALL SELECT 'sql', 'total_rows', SUM(rows_returned) FROM log WHERE {SQL_AREA}
  UNION ALL SELECT 'sql', 'errors', COUNT(*) FILTER (WHERE status = 'error') FROM log WHERE {SQL_AREA}
  UNION ALL SELECT 'sql', 'timeouts', COUNT(*) FILTER (WHERE status = 'timeout') FROM log WHERE {SQL_AREA}
  UNION ALL SELECT 'retrieval', 'total_searches', COUNT(*) FROM log WHERE operation = 'view'
  UNION ALL SELECT 'retrieval', 'total_latency_ms', SUM(latency_ms) FROM log WHERE operation = 'view'
  UNION ALL SELECT 'retrieval', 'total_results', SUM(rows_returned) FROM log WHERE operation = 'view'
  UNION ALL SELECT 'requests', 'count', count FROM req
  UNION ALL SELECT 'requests', 'avg_ms', avg_ms FROM req
  UNION ALL SELECT 'requests', 'p50_ms', p50_ms FROM req
  UNION ALL SELECT 'requests', 'p95_ms', p95_ms FROM req
  UNION ALL SELECT 'requests', 'p99_ms', p99_ms FROM req)
""")
def summary(t):
    every = log(t)
    return tel.metrics_summary(every, every.where(SQL_AREA), searches(t), every).withColumn("value", F.round("value", 2))


@query("flt9_visible_counts", """
SELECT c_custkey AS user_id, c_acctbal > 9500 AS is_admin,
  CASE WHEN c_acctbal > 9500 THEN (SELECT COUNT(*) FROM orders) ELSE coalesce(n, 0) END AS visible
FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def visible(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 9500).alias("is_admin"))
    return audit.visible_counts(t.orders.select(F.col("o_custkey").alias("created_by")), users)


@query("flt9_visible_rows", "SELECT o_orderkey, o_custkey AS created_by FROM orders WHERE o_custkey = 7")
def visible_to_one(t):
    return audit.visible_rows(t.orders.select("o_orderkey", F.col("o_custkey").alias("created_by")), 7, False)


@query("flt11_query_history", """
SELECT event_id, user_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5
""")
def page(t):
    return audit.history(t.events.select("event_id", "user_id", "ts", "event_type"), 7, 20, 5, created="ts", tie="event_id")


def walked(made, owner, limit, count):
    """The first ``count`` pages of an owner, each asked for with the end of the one before."""
    out, cursor = None, None
    for number in range(count):
        rows = pages.page_before(made, owner, limit, cursor)
        last = rows.orderBy("ts", "event_id").first()
        if last is not None:
            cursor = (last["ts"], last["event_id"])
        rows = rows.withColumn("page", F.lit(number))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("flt11_history_by_key", """
SELECT event_id, user_id, ts, event_type, CAST((n - 1) // 15 AS INTEGER) AS page FROM (
  SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id = 7) WHERE n <= 45
""")
def page_by_key(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    return walked(pages.write_pages(rows, jobs.scratch(t.spark, "history"), "user_id", "ts", "event_id"), 7, 15, 3)


@query("flt13_audit_by_key", """
SELECT event_id, user_id, ts, event_type, CAST((n - 1) // 40 AS INTEGER) AS page FROM (
  SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 80
""")
def audited_by_key(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    return walked(pages.write_pages(rows, jobs.scratch(t.spark, "audit"), "event_type", "ts", "event_id"), "error", 40, 2)


@query("flt13_audit_query", """
SELECT event_id, ts AS timestamp, user_id, event_type, severity FROM (
  SELECT *, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity FROM events)
WHERE event_type = 'error' AND severity = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'
ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def audited(t):
    rows = t.events.select("event_id", F.col("ts").alias("timestamp"), "user_id", "event_type",
                           F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"))
    return audit.audit_query(rows, event_type="error", severity="error", start="2024-01-05", end="2024-01-20", limit=100)


@query("jn3_executions", """
SELECT o_orderkey AS execution_id, o_custkey AS schedule_id, o_orderdate AS started_at, o_orderstatus AS status, c_name AS name, c_nationkey AS created_by
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
""")
def runs(t):
    executions = t.orders.select(F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("schedule_id"),
                                 F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    schedules = t.customer.select(F.col("c_custkey").alias("schedule_id"), F.col("c_name").alias("name"),
                                  F.col("c_nationkey").alias("created_by"))
    return audit.executions(executions, schedules, owner_id=3)


def clients(events):
    k = maps.json_field("props", "$.k")
    kind = F.col("event_type")
    seen = events.select(
        "event_id", "ts", "event_type", F.when(kind.isin("purchase", "error"), F.col("user_id")).alias("user_id"),
        F.when(kind == "click", F.concat(F.lit(" 10.0.0."), k, F.lit(" , 172.16.0.1"))).alias("forwarded_for"),
        F.when(kind != "signup", F.concat(F.lit("192.168.1."), k)).alias("host"))
    return seen.withColumn("client_key", audit.client_key())


CLIENT_SQL = """
cl AS (SELECT event_id, ts, event_type, CASE WHEN event_type IN ('purchase', 'error') THEN 'user:' || user_id
  WHEN event_type = 'click' THEN 'ip:10.0.0.' || json_extract_string(props, '$.k') WHEN event_type = 'view' THEN 'ip:192.168.1.' || json_extract_string(props, '$.k')
  ELSE 'ip:unknown' END AS client_key FROM events)
"""


@query("str4_client_key", f"WITH {CLIENT_SQL} SELECT event_id, client_key FROM cl")
def keys(t):
    return clients(t.events).select("event_id", "client_key")


# Limits wide enough that the sample's sparse traffic runs into them; one class has none.
LIMITS = {"user": (3, 86_400), "address": (2, 43_200)}


def limited(events):
    name = F.when(F.col("event_type").isin("purchase", "error"), "user").when(F.col("event_type") != "signup", "address").otherwise("free")
    return limits.with_limits(clients(events).withColumn("limit_class", name), limits=LIMITS)


LIMITED_SQL = CLIENT_SQL + """,
li AS (SELECT *, CASE WHEN event_type IN ('purchase', 'error') THEN 'user' WHEN event_type <> 'signup' THEN 'address' ELSE 'free' END AS limit_class,
  CASE WHEN event_type IN ('purchase', 'error') THEN 3 WHEN event_type <> 'signup' THEN 2 END AS lim,
  CASE WHEN event_type IN ('purchase', 'error') THEN 86400 WHEN event_type <> 'signup' THEN 43200 END AS win FROM cl)
"""


@query("str3_limit_table", f"WITH {LIMITED_SQL} SELECT event_id, limit_class, lim AS \"limit\", win AS window_seconds FROM li")
def limit_rows(t):
    return limited(t.events).select("event_id", "limit_class", "limit", "window_seconds")


@query("str2_usage", """
SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS usage FROM events
""")
def usage(t):
    return limits.usage(t.events, 86_400, key="user_id")


ADMISSION_SQL = f"""
WITH RECURSIVE {LIMITED_SQL},
ord AS (SELECT event_id, client_key, lim, CAST(win AS BIGINT) * 1000000 AS w, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_key ORDER BY ts, event_id) AS rn
  FROM li WHERE lim IS NOT NULL),
walk AS (
  SELECT client_key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS held, false AS admitted, 0 AS remaining, CAST(0 AS BIGINT) AS reset_seconds
  FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.client_key, o.rn, o.event_id,
    CASE WHEN len(list_filter(s.held, lambda x: x > o.us - o.w)) >= o.lim THEN list_filter(s.held, lambda x: x > o.us - o.w)
         ELSE list_append(list_filter(s.held, lambda x: x > o.us - o.w), o.us) END,
    len(list_filter(s.held, lambda x: x > o.us - o.w)) < o.lim,
    CASE WHEN len(list_filter(s.held, lambda x: x > o.us - o.w)) < o.lim THEN CAST(o.lim - len(list_filter(s.held, lambda x: x > o.us - o.w)) - 1 AS INTEGER) ELSE 0 END,
    CASE WHEN len(list_filter(s.held, lambda x: x > o.us - o.w)) < o.lim THEN o.w // 1000000
         ELSE greatest((list_filter(s.held, lambda x: x > o.us - o.w)[1] + o.w - o.us) // 1000000, 1) END
  FROM walk s JOIN ord o ON o.client_key = s.client_key AND o.rn = s.rn + 1)
SELECT event_id, admitted, CAST(remaining AS INTEGER) AS remaining, CAST(reset_seconds AS INTEGER) AS reset_seconds FROM walk WHERE rn > 0
UNION ALL SELECT event_id, true, 0, 0 FROM li WHERE lim IS NULL
"""


@query("str1_rate_limit", ADMISSION_SQL)
def admitted(t):
    return limits.rate_limit(limited(t.events))


@query("str1_rate_limit_stream", ADMISSION_SQL)
def admitted_stream(t):
    stream = jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    decided = jobs.rate_limit_stream(limited(stream))
    return jobs.run_available(decided, jobs.scratch(t.spark, "admitted"), jobs.scratch(t.spark, "progress"))


@query("str1_rate_limit_in_order", ADMISSION_SQL)
def admitted_in_order(t):
    """Requests in any order of files; one row long after them ends the input."""
    end = jobs.scratch(t.spark, "end")
    ordered.end_of_input(t.events).write.parquet(end)
    events = jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    stream = events.unionAll(jobs.read_stream(t.spark, end, t.events.schema))
    with ordered.rocksdb_state(t.spark):
        decided = ordered.rate_limit_in_order(limited(stream), "31 days").where("event_id IS NOT NULL")
        return jobs.run_available(decided, jobs.scratch(t.spark, "admitted"), jobs.scratch(t.spark, "progress"))


@query("str2_usage_of_admitted", f"""
SELECT li.event_id, COUNT(*) OVER w AS usage, COUNT(*) FILTER (WHERE a.admitted) OVER w AS admitted_usage
FROM (WITH {LIMITED_SQL} SELECT * FROM li) li JOIN ({ADMISSION_SQL}) a ON a.event_id = li.event_id
WINDOW w AS (PARTITION BY client_key ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
""")
def usage_of_admitted(t):
    """Requests and admitted requests of a client in the day up to each request."""
    asked = limited(t.events)
    let_through = asked.join(limits.rate_limit(asked).where("admitted").select("event_id"), "event_id")
    return limits.usage(asked, 86_400, admitted=let_through)


@query("str5_audit_groups", """
SELECT event_id, event_type, ts AS timestamp, CAST(ts AS DATE) AS day, true AS small_group FROM events
""")
def audit_grouped(t):
    """Every event is sent twice and stored once, in groups of at most a hundred."""
    sent = [jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema) for _ in range(2)]
    rows = sent[0].unionAll(sent[1]).select("event_id", "event_type", F.col("ts").alias("timestamp"))
    path = jobs.scratch(t.spark, "audit")
    jobs.audit_groups_stream(rows, path, jobs.scratch(t.spark, "progress"), available_now=True).awaitTermination()
    stored = t.spark.read.parquet(path).withColumn("group", F.input_file_name())
    sizes = stored.groupBy("group").agg((F.count(F.lit(1)) <= jobs.AUDIT_GROUP).alias("small_group"))
    return stored.join(sizes, "group").select("event_id", "event_type", "timestamp", "day", "small_group")


@query("str5_audit_stream", """
SELECT event_id, event_type, ts AS timestamp, CAST(ts AS DATE) AS day FROM events
""")
def audit_stored(t):
    stream = jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    rows = stream.select("event_id", "event_type", F.col("ts").alias("timestamp"))
    path = jobs.scratch(t.spark, "audit")
    jobs.audit_stream(rows, path, jobs.scratch(t.spark, "progress"), available_now=True).awaitTermination()
    return t.spark.read.parquet(path)


@query("str6_telemetry_stream", f"""
WITH {LOG_SQL},
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, * FROM log)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, operation, COUNT(*) AS calls, COUNT(*) FILTER (WHERE status = 'error') AS errors,
  CAST(SUM(total_tokens) AS BIGINT) AS tokens, ROUND(AVG(latency_ms), 6) AS avg_ms, MAX(latency_ms) AS max_ms
FROM w GROUP BY window_start, operation
""")
def telemetry_windows(t):
    stream = jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    windows = jobs.telemetry_stream(as_log(stream), window="1 hour")
    out = jobs.run_available(windows, jobs.scratch(t.spark, "telemetry"), jobs.scratch(t.spark, "progress"))
    out = jobs.with_open_windows(out, as_log(t.events), window="1 hour")
    return out.withColumn("avg_ms", F.round("avg_ms", 6))


@query("str6_window_percentiles", f"""
WITH {LOG_SQL}
SELECT CAST(ts AS DATE) AS day, operation, COUNT(*) AS calls, MIN(latency_ms) AS min_ms, MAX(latency_ms) AS max_ms,
  true AS p50_in_band, true AS p95_in_band, true AS p99_in_band FROM log GROUP BY ALL
""")
def percentile_windows(t):
    """Sketches of hours from the stream, merged into days; whether each percentile has its rank within the error."""
    stream = jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    hours = jobs.run_available(jobs.latency_sketches(as_log(stream), window="1 hour"), jobs.scratch(t.spark, "sketches"),
                               jobs.scratch(t.spark, "progress"))
    hours = jobs.with_open_windows(hours, log(t), jobs.latency_sketches, window="1 hour")
    days = jobs.sketch_percentiles(hours.withColumn("day", F.col("window_start").cast("date")), ["day", "operation"])
    names = [f"p{round(p * 100)}" for p in tel.PERCENTILES]
    ranks = log(t).withColumn("day", F.col("ts").cast("date")).join(days, ["day", "operation"]).groupBy("day", "operation").agg(
        *[F.count_if(F.col("latency_ms") < F.col(f"{n}_ms")).alias(f"{n}_below") for n in names],
        *[F.count_if(F.col("latency_ms") <= F.col(f"{n}_ms")).alias(f"{n}_upto") for n in names])
    slack = F.lit(jobs.rank_error()) * F.col("calls")

    def in_band(name, p):
        wanted = F.lit(p) * F.col("calls")
        return ((F.col(f"{name}_below") <= wanted + slack) & (F.col(f"{name}_upto") >= wanted - slack)).alias(f"{name}_in_band")

    return days.join(ranks, ["day", "operation"]).select(
        "day", "operation", "calls", "min_ms", "max_ms", *[in_band(n, p) for n, p in zip(names, tel.PERCENTILES)])


@query("fn5_sensitive_values", """
SELECT event_id, user_id || '-' || event_type AS token_after, 'open' AS note_after, true AS token_hidden, true AS note_same FROM events
""")
def protected(t):
    raw = F.create_map(F.lit("Api_Key"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type"), F.lit("note"), F.lit("open"))
    key = F.lit("0123456789abcdef")
    closed = t.events.select("event_id", raw.alias("raw"), maps.protect(raw, key).alias("closed"))
    opened = closed.withColumn("open", maps.reveal("closed", key))
    return opened.select("event_id", F.col("open")["Api_Key"].alias("token_after"), F.col("open")["note"].alias("note_after"),
                         (F.col("closed")["Api_Key"] != F.col("raw")["Api_Key"]).alias("token_hidden"),
                         (F.col("closed")["note"] == F.col("raw")["note"]).alias("note_same"))


@query("fn1_text_functions", r"""
SELECT conv_id, turn, lower(trim(text, ' ')) AS low, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words,
  substring(text, 3, 10) AS part, regexp_extract(text, '([a-z]+)', 1) AS first_lower, regexp_replace(text, '[aeiou]', '_', 'g') AS masked,
  regexp_matches(text, '^[A-Z]') AS capital FROM conversations
""")
def text_functions(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.conversations.select(
        "conv_id", "turn", F.lower(F.trim("text")).alias("low"), F.size(words).cast("bigint").alias("words"),
        F.substring("text", 3, 10).alias("part"), F.regexp_extract("text", "([a-z]+)", 1).alias("first_lower"),
        F.regexp_replace("text", "[aeiou]", "_").alias("masked"), F.col("text").rlike("^[A-Z]").alias("capital"))


@query("fn2_date_functions", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INTEGER) AS y,
  CAST(quarter(o_orderdate) AS INTEGER) AS q, o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 90 DAYS AS recent FROM orders
""")
def date_functions(t):
    d = F.col("o_orderdate")
    recent = d >= F.lit("2001-01-01").cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    return t.orders.select("o_orderkey", F.date_trunc("month", d).cast("date").alias("month"), F.year(d).alias("y"),
                           F.quarter(d).alias("q"), recent.alias("recent"))


@query("fn3_coalesce_cast", """
SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END, -1) AS whole,
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS k FROM events
""")
def casts(t):
    whole = F.when(F.col("event_type") != "error", F.floor("value").cast("bigint"))
    return t.events.select("event_id", F.coalesce(whole, F.lit(-1)).alias("whole"), maps.json_field("props", "$.k", "double").alias("k"))


@query("fn4_math", """
SELECT event_id, ROUND(pow(1.01, value / 100), 8) AS grown, ROUND(log2(value + 1), 8) AS bits, abs(value - 250) AS away,
  ROUND(sqrt(value), 8) AS root FROM events
""")
def math(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(F.pow(F.lit(1.01), v / 100), 8).alias("grown"), F.round(F.log2(v + 1), 8).alias("bits"),
                           F.abs(v - 250).alias("away"), F.round(F.sqrt(v), 8).alias("root"))


@query("fn7_maps_and_json", """
SELECT event_id, event_type AS kind, 'b' AS own, 'none' AS missing, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(2 AS INTEGER) AS n_keys, [event_id, user_id] AS first_two FROM events
""")
def map_functions(t):
    merged = maps.merge(F.create_map(F.lit("kind"), F.lit("a"), F.lit("own"), F.lit("b")),
                        F.create_map(F.lit("kind"), F.col("event_type")))
    return t.events.select("event_id", maps.lookup(merged, "kind", "none").alias("kind"), maps.lookup(merged, "own", "none").alias("own"),
                           maps.lookup(merged, "absent", "none").alias("missing"), maps.json_field("props", "$.k", "int").alias("k"),
                           F.size(merged).alias("n_keys"), F.slice(F.array("event_id", "user_id", F.lit(0)), 1, 2).alias("first_two"))


def report_source(t):
    """One report per nation over the orders of its customers."""
    customers = t.customer.select("c_custkey", F.col("c_nationkey").alias("report_id"))
    return (t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
            .join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey"))


@query("src15_report_rows", """
WITH r AS (SELECT c_nationkey AS report_id, o_orderkey, o_custkey, o_orderdate, o_totalprice,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS row_number,
  COUNT(*) OVER (PARTITION BY c_nationkey) AS row_count FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT *, CASE WHEN row_count > 50 THEN 'Showing first 50 of ' || row_count || ' rows' END AS note FROM r WHERE row_number <= 50
""")
def report_rows(t):
    return reports.report_rows(report_source(t), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50)


@query("src15_report_sources", """
SELECT doc_id, substring(text, 1, 300) || '...' AS snippet,
  format('{:.0f}', (coalesce(quality, 0) * 0.5 + coalesce(toxic, 0) * 0.25 + 0.2) * 100) || '%' AS relevance
FROM documents LEFT JOIN labels USING (doc_id)
""")
def report_hits(t):
    hits = (t.documents.select("doc_id", F.col("text").alias("chunk_content")).join(t.labels, "doc_id", "left")
            .withColumn("score", F.coalesce("quality", F.lit(0)) * 0.5 + F.coalesce("toxic", F.lit(0)) * 0.25 + 0.2))
    return reports.report_sources(hits).select("doc_id", "snippet", "relevance")


def _money(v: str) -> str:
    return (f"CASE WHEN abs({v}) >= 1e6 THEN format('{{:.2f}}', {v} / 1e6) || 'M' WHEN abs({v}) >= 1e3 THEN format('{{:.2f}}', {v} / 1e3) || 'K' "
            f"ELSE format('{{:,.2f}}', {v}) END")


@query("src15_report_sections", CONF_SQL + f"""
, pts AS (SELECT event_id, value, CAST(unnest(range(1, 16)) AS INTEGER) AS i FROM conf WHERE has_forecast),
fc AS (SELECT event_id, i, value + i AS y, (value + i) * 0.9 AS lo, (value + i) * 1.1 AS hi FROM pts)
SELECT event_id AS report_id, 'financial' AS section, 1 AS ordinal, 'Net Present Value' AS label, '$' || {_money('value * 1000')} AS value_text FROM conf WHERE has_financial AND event_type = 'signup'
UNION ALL SELECT event_id, 'financial', 2, 'Internal Rate of Return', format('{{:.2f}}', value / 1000 * 100) || '%' FROM conf WHERE has_financial AND event_type = 'purchase'
UNION ALL SELECT event_id, 'forecast', 1, 'Next Period (Period_1)', {_money('y')} FROM fc WHERE i = 1
UNION ALL SELECT event_id, 'forecast', 2, 'Confidence Interval', {_money('lo')} || ' - ' || {_money('hi')} FROM fc WHERE i = 1
UNION ALL SELECT event_id, 'forecast_horizon', i, 'Period_' || i, {_money('y')} || ' [' || {_money('lo')} || ', ' || {_money('hi')} || ']' FROM fc WHERE i <= 12
UNION ALL SELECT event_id, 'sensitivity', 1, 'Discount Rate', format('{{:.2f}}', value) || ', ' || format('{{:.2f}}', value / 2) FROM conf WHERE has_financial
UNION ALL SELECT event_id, 'schedule', 1, 'Name', 'user ' || user_id FROM conf WHERE schedule_id IS NOT NULL
UNION ALL SELECT event_id, 'schedule', 2, 'Cron', '0 9 * * 1' FROM conf WHERE schedule_id IS NOT NULL
UNION ALL SELECT event_id, 'schedule', 3, 'Recipients', 'a@example.com, b@example.com' FROM conf WHERE schedule_id IS NOT NULL
UNION ALL SELECT event_id, 'schedule', 4, 'Format', 'pdf' FROM conf WHERE schedule_id IS NOT NULL
""")
def report_sections(t):
    point = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.struct(
        F.concat(F.lit("Period_"), i.cast("string")).alias("date"), (F.col("value") + i).alias("yhat"),
        ((F.col("value") + i) * 0.9).alias("yhat_lower"), ((F.col("value") + i) * 1.1).alias("yhat_upper")))
    rows = (with_texts(t).withColumn("report_id", F.col("event_id"))
            .withColumn("forecast", F.when(F.col("has_forecast"), point))
            .withColumn("sensitivity", F.when(F.col("has_financial"), F.create_map(
                F.lit("discount_rate"), F.array(F.col("value"), F.col("value") / 2)))))
    return reports.report_sections(rows)
