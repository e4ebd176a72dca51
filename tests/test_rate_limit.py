import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import rate_limit as limits
from ledgerlight.operators.guard import within_time
from ledgerlight.streaming import jobs


def brute(rows, limit, window):
    held, out = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = held[key] = [t for t in held.get(key, []) if t > ts - dt.timedelta(seconds=window)]
        if len(mine) >= limit:
            out[i] = (False, 0, max(int((mine[0] + dt.timedelta(seconds=window) - ts).total_seconds()), 1))
        else:
            out[i] = (True, limit - len(mine) - 1, window)
            mine.append(ts)
    return out


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", start + dt.timedelta(seconds=rng.randint(0, 20_000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, client_key string, ts timestamp_ntz").repartition(3)
    return rows, df.withColumn("limit", F.lit(5)).withColumn("window_seconds", F.lit(120))


def decisions(df):
    return {r.event_id: (r.admitted, r.remaining, r.reset_seconds) for r in df.collect()}


@pytest.mark.parametrize("slice_rows", [limits.SLICE_ROWS, 300])
def test_batch_equals_brute_force(requests, slice_rows):
    rows, df = requests
    assert decisions(limits.rate_limit(df, slice_rows=slice_rows)) == brute(rows, 5, 120)


def test_a_slice_hands_its_admissions_on(spark):
    # One request a second and three per ten seconds: every slice depends on the one before.
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "k", start + dt.timedelta(seconds=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, client_key string, ts timestamp_ntz")
    df = df.withColumn("limit", F.lit(3)).withColumn("window_seconds", F.lit(10))
    assert decisions(limits.rate_limit(df, slice_rows=7)) == brute(rows, 3, 10)


def test_unknown_class_is_admitted(spark):
    df = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1), "nothing"), (2, "k", dt.datetime(2024, 1, 1), "auth")],
                               "event_id long, client_key string, ts timestamp_ntz, limit_class string")
    limited = limits.with_limits(df, limits={"query": (1, 1)})
    assert decisions(limits.rate_limit(limited)) == {1: (True, 0, 0), 2: (True, 9, 300)}


def test_classes_of_a_client_are_counted_apart(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "k", start + dt.timedelta(seconds=i), "auth" if i % 2 else "api") for i in range(30)]
    df = limits.with_limits(spark.createDataFrame(rows, "event_id long, client_key string, ts timestamp_ntz, limit_class string"))
    denied = [r.event_id for r in limits.rate_limit(df).where("not admitted").collect()]
    assert sorted(denied) == [21, 23, 25, 27, 29]


def test_usage(requests):
    rows, df = requests
    got = {r.event_id: r.usage for r in limits.usage(df, 120, stretch=2).collect()}
    want = {i: sum(1 for _j, k, t in rows if k == key and ts - dt.timedelta(seconds=120) < t <= ts) for i, key, ts in rows}
    assert got == want


def test_usage_of_a_busy_client_is_one_running_sum(spark):
    # All within one window: a frame summed anew for each request would add billions of times.
    day = spark.range(300_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("client_key"),
                                      F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 0.25)").alias("ts"))
    got = within_time(spark, lambda: limits.usage(day, 86_400, admitted=day.where("event_id % 2 = 0")).selectExpr(
        "count_if(usage = event_id + 1)", "count_if(admitted_usage = event_id div 2 + 1)").first(), 15)
    assert tuple(got) == (300_000, 300_000)


def test_usage_counts_equal_times_and_ends_of_windows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "k" if i % 3 else None, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 0, 10, 20, 20, 20, 30, 39, 40, 41, 60, 80, 80, 99))]
    df = spark.createDataFrame(rows, "event_id long, client_key string, ts timestamp_ntz")
    log = df.where("event_id % 2 = 0")
    window = dt.timedelta(seconds=20)

    def count(key, ts, every):
        return sum(1 for i, k, t in rows if k == key and ts - window < t <= ts and i % every == 0)

    for stretch in (1, 2, 8):
        got = {r[0]: (r[1], r[2]) for r in limits.usage(df, 20, stretch=stretch, admitted=log).collect()}
        assert got == {i: (count(k, t, 1), count(k, t, 2)) for i, k, t in rows}


def test_stream_equals_batch(spark, requests, tmp_path):
    rows, df = requests
    # Two files in time order, so the second batch starts from the first one's state.
    half = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=10_000)
    (df.where(F.col("ts") < F.lit(half)).coalesce(1).write.parquet(str(tmp_path / "in" / "a")))
    (df.where(F.col("ts") >= F.lit(half)).coalesce(1).write.parquet(str(tmp_path / "in" / "b")))
    stream = jobs.read_stream(spark, str(tmp_path / "in" / "*"), df.schema, files_per_trigger=1)
    out = jobs.run_available(jobs.rate_limit_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert decisions(out) == brute(rows, 5, 120)


def test_idle_keys_are_forgotten_without_changing_decisions(spark, requests, tmp_path):
    rows, df = requests
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), df.schema)
    out = jobs.run_available(jobs.rate_limit_stream(stream, idle="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert decisions(out) == brute(rows, 5, 120)


def test_audit_stream_appends_each_event_once(spark, tmp_path):
    schema = "event_id long, event_type string, timestamp timestamp"
    spark.createDataFrame([(1, "login_success", dt.datetime(2024, 1, 1)), (2, "logout", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    src = str(tmp_path / "in" / "*")
    from pyspark.sql import types as T
    struct = T._parse_datatype_string(schema)

    def run():
        jobs.audit_stream(jobs.read_stream(spark, src, struct), str(tmp_path / "out"), str(tmp_path / "cp"), True).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2]
    spark.createDataFrame([(3, "logout", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    assert run() == [1, 2, 3] and run() == [1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "out")).where("timestamp is null").count() == 0


def test_telemetry_stream_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("op", base + dt.timedelta(seconds=s), 10.0 + s, "error" if s == 3 else "success", 5) for s in (0, 3, 16, 300)]
    df = spark.createDataFrame(rows, "operation string, ts timestamp, latency_ms double, status string, total_tokens int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.telemetry_stream(jobs.read_stream(spark, str(tmp_path / "in"), df.schema))
    out = jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).orderBy("window_start").collect()
    assert [(r.calls, r.errors, r.avg_ms) for r in out] == [(2, 1, 11.5), (1, 0, 26.0)]
