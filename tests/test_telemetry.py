import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import audit, order_stats, reports, telemetry as tel


@pytest.mark.parametrize("small", [order_stats.SMALL_GROUP, 10])
def test_percentiles_by_position(spark, monkeypatch, small):
    monkeypatch.setattr(order_stats, "SMALL_GROUP", small)
    rng = random.Random(7)
    groups = {"hot": [round(rng.lognormvariate(3, 1), 2) for _ in range(20_000)], "even": [float(i % 7) for i in range(1000)], "one": [5.0], "ten": [float(i) for i in range(10)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, ["g", "latency_ms"]).repartition(4)
    want = {g: [sorted(vs)[min(int(len(vs) * p), len(vs) - 1)] for p in tel.PERCENTILES] for g, vs in groups.items()}
    got = {r.g: [r.p50_ms, r.p95_ms, r.p99_ms] for r in tel.request_metrics(df, ["g"]).collect()}
    assert got == want
    everything = sorted(v for _g, v in rows)
    row = tel.request_metrics(df).first()
    assert [row.p50_ms, row.p95_ms, row.p99_ms] == [everything[int(len(rows) * p)] for p in tel.PERCENTILES]


def test_no_requests_give_zeros(spark):
    row = tel.request_metrics(spark.createDataFrame([], "latency_ms double")).first()
    assert tuple(row) == (0, 0.0, 0.0, 0.0, 0.0)


def test_errors_and_timeouts_do_not_overlap(spark):
    df = spark.createDataFrame([("error", 1.0, 0), ("timeout", 2.0, 0), ("success", 3.0, 7)], ["status", "latency_ms", "rows_returned"])
    assert tuple(tel.sql_metrics(df).first()) == (3, 6.0, 7, 1, 1)
    assert tuple(tel.sql_metrics(df.where("status = 'x'")).first()) == (0, 0.0, 0, 0, 0)


def test_audit_filters_compose(spark):
    rows = [(i, f"u{i % 2}", "login_failed" if i % 3 else "logout", "warning" if i % 2 else "info", f"2024-01-{i + 1:02d} 00:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, ["event_id", "user_id", "event_type", "severity", "t"]).withColumn("timestamp", F.col("t").cast("timestamp"))
    got = [r.event_id for r in audit.audit_query(df, user_id="u1", event_type="login_failed", start="2024-01-02", end="2024-01-08", limit=2).collect()]
    assert got == [7, 5]
    assert [r.event_id for r in audit.audit_query(df, severity="info", newest_first=False, limit=1).collect()] == [0]


def test_visibility(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], ["id", "created_by"])
    users = spark.createDataFrame([("a", False), ("root", True), ("z", False)], ["user_id", "is_admin"])
    assert {r.user_id: r.visible for r in audit.visible_counts(df, users).collect()} == {"a": 2, "root": 3, "z": 0}
    assert audit.visible_rows(df, "b", False).count() == 1 and audit.visible_rows(df, "b", True).count() == 3


def test_client_key(spark):
    rows = [(7, "1.1.1.1", "h"), (None, " 2.2.2.2 , 3.3.3.3", "h"), (None, None, "h"), (None, "", None)]
    df = spark.createDataFrame(rows, "user_id int, forwarded_for string, host string")
    assert [r.k for r in df.select(audit.client_key().alias("k")).collect()] == ["user:7", "ip:2.2.2.2", "ip:h", "ip:unknown"]


def test_report_rows_are_cut_and_counted(spark):
    df = spark.range(130).select(F.when(F.col("id") < 120, "big").otherwise("small").alias("report_id"), F.col("id").alias("v"))
    rows = reports.report_rows(df, [F.asc("v")], 50).collect()
    big = [r for r in rows if r.report_id == "big"]
    assert len(big) == 50 and big[0].row_count == 120 and big[0].note == "Showing first 50 of 120 rows" and max(r.v for r in big) == 49
    small = [r for r in rows if r.report_id == "small"]
    assert len(small) == 10 and small[0].note is None


def test_reports_are_written_per_report(spark, tmp_path):
    tables = {"rows": spark.createDataFrame([("a", 1), ("b", 2)], ["report_id", "v"])}
    reports.write_reports(tables, str(tmp_path))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [("a", 1), ("b", 2)]
