import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import rate_limit as limits
from ledgerlight.streaming import jobs, ordered
from tests.test_rate_limit import brute, decisions

START = dt.datetime(2024, 1, 1)
REQUEST = "event_id long, client_key string, ts timestamp_ntz"


def limited(df):
    return df.withColumn("limit", F.lit(4)).withColumn("window_seconds", F.lit(150))


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(4)
    return [(i, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", START + dt.timedelta(seconds=rng.randint(0, 6000))) for i in range(900)]


def write_files(spark, rows, folder, files, order):
    """Rows in ``files`` stretches of time, written in the given order of stretches."""
    rows = sorted(rows, key=lambda r: r[2])
    size = -(-len(rows) // files)
    for n, at in enumerate(order):
        df = limited(spark.createDataFrame(rows[at * size:(at + 1) * size], REQUEST))
        df.coalesce(1).write.parquet(os.path.join(folder, f"{n:02d}"))
        os.utime(_only_file(os.path.join(folder, f"{n:02d}")), (1_700_000_000 + n, 1_700_000_000 + n))
    return df.schema


def _only_file(folder):
    return next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet"))


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [1, 0, 3, 2]])
def test_order_of_files_does_not_matter(spark, requests, tmp_path, order):
    schema = write_files(spark, requests, str(tmp_path / "in"), 4, order)
    end = limited(ordered.end_of_input(spark.createDataFrame(requests, REQUEST)))
    end.coalesce(1).write.parquet(str(tmp_path / "in" / "99"))
    stream = jobs.read_stream(spark, str(tmp_path / "in" / "*"), schema, 1)
    with ordered.rocksdb_state(spark):
        before = spark.conf.get(ordered.STATE_STORE)
        out = jobs.run_available(ordered.rate_limit_in_order(stream, "4000 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert before == ordered.ROCKSDB and spark.conf.get(ordered.STATE_STORE) != before
    got = decisions(out)
    assert got == brute(requests, 4, 150) and None not in got


def test_requests_wait_for_the_watermark(spark, requests, tmp_path):
    """Nothing is decided before its time has passed, and a restart goes on from the state."""
    schema = write_files(spark, requests, str(tmp_path / "in"), 2, [0, 1])
    stream = jobs.read_stream(spark, str(tmp_path / "in" / "*"), schema)
    with ordered.rocksdb_state(spark):
        first = decisions(jobs.run_available(ordered.rate_limit_in_order(stream, "500 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")))
        last = max(r[2] for r in requests)
        whole = brute(requests, 4, 150)
        assert first == {r[0]: whole[r[0]] for r in requests if r[2] <= last - dt.timedelta(seconds=500)}
        limited(ordered.end_of_input(spark.createDataFrame(requests, REQUEST))).write.parquet(str(tmp_path / "in" / "end"))
        again = decisions(jobs.run_available(ordered.rate_limit_in_order(stream, "500 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert again == whole


def test_ids_stay_whole_beside_missing_ones(spark, tmp_path):
    big = 2**60 + 1
    df = limited(spark.createDataFrame([(big, "k", START), (None, "k", START), (big + 1, "k", START + dt.timedelta(seconds=1))], REQUEST)).coalesce(1)
    df.write.parquet(str(tmp_path / "in" / "a"))
    limited(ordered.end_of_input(df.select("event_id", "client_key", "ts"))).write.parquet(str(tmp_path / "in" / "b"))
    with ordered.rocksdb_state(spark):
        out = jobs.run_available(ordered.rate_limit_in_order(jobs.read_stream(spark, str(tmp_path / "in" / "*"), df.schema), "1 hour"),
                                 str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.event_id or 0, r.admitted) for r in out.collect())[-2:] == [(big, True), (big + 1, True)]


def test_a_class_without_limit_does_not_wait(spark, tmp_path):
    df = spark.createDataFrame([(1, "k", START, "nothing"), (2, "k", START, "auth")], REQUEST + ", limit_class string")
    df = limits.with_limits(df)
    df.write.parquet(str(tmp_path / "in"))
    with ordered.rocksdb_state(spark):
        out = jobs.run_available(ordered.rate_limit_in_order(jobs.read_stream(spark, str(tmp_path / "in"), df.schema), "1 hour"),
                                 str(tmp_path / "out"), str(tmp_path / "cp"))
    assert decisions(out) == {1: (True, 0, 0)}


def test_admitted_usage(spark, requests):
    df = limited(spark.createDataFrame(requests, REQUEST))
    log = df.join(limits.rate_limit(df).where("admitted").select("event_id"), "event_id")
    let = {i for i, (ok, _r, _s) in brute(requests, 4, 150).items() if ok}
    got = {r.event_id: (r.usage, r.admitted_usage) for r in limits.usage(df, 150, stretch=2, admitted=log).collect()}
    want = {}
    for i, key, ts in requests:
        near = [j for j, k, t in requests if k == key and ts - dt.timedelta(seconds=150) < t <= ts]
        want[i] = (len(near), sum(j in let for j in near))
    assert got == want


def test_audit_groups_are_small_and_written_once(spark, tmp_path):
    schema = "event_id long, event_type string, timestamp timestamp"
    rows = [(i, "logout", None if i % 9 == 0 else START + dt.timedelta(days=i % 400)) for i in range(730)]
    first = spark.createDataFrame(rows + rows[:300], schema).coalesce(1)  # resent in the same batch
    first.write.parquet(str(tmp_path / "in" / "a"))

    def run():
        stream = jobs.read_stream(spark, str(tmp_path / "in" / "*"), first.schema)
        jobs.audit_groups_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out"))
        assert out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= jobs.AUDIT_GROUP
        assert out.where("timestamp is null").count() == 0
        return sorted(r.event_id for r in out.collect())

    assert run() == list(range(730))
    spark.createDataFrame(rows[100:200] + [(1000, "logout", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    assert run() == [*range(730), 1000]  # resent in a later batch
    commits = tmp_path / "cp" / "commits"
    last = max((p for p in os.listdir(commits) if p.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(commits / name):
            os.remove(commits / name)  # as if the job had died before it could note the batch
    assert run() == [*range(730), 1000]


def test_sketches_of_windows_merge(spark, tmp_path):
    rng = random.Random(8)
    rows = [("a" if i % 4 else "b", START + dt.timedelta(seconds=i // 20), rng.lognormvariate(2, 1) if i % 50 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "operation string, ts timestamp, latency_ms double").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.latency_sketches(jobs.read_stream(spark, str(tmp_path / "in"), df.schema), window="1 minute")
    written = jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    every = jobs.with_open_windows(written, df, jobs.latency_sketches, window="1 minute")
    assert written.count() < every.count() and every.groupBy("window_start", "operation").count().where("count > 1").count() == 0
    got = {r.operation: r for r in jobs.sketch_percentiles(every, ["operation"]).collect()}
    for name in "ab":
        values = sorted(v for o, _t, v in rows if o == name and v is not None)
        r = got[name]
        assert (r.calls, r.min_ms, r.max_ms) == (len(values), values[0], values[-1])
        for p, v in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
            below, upto = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert below - 3 * jobs.rank_error() <= p <= upto + 3 * jobs.rank_error()
    small = jobs.sketch_percentiles(every.where("operation = 'b'"), ["window_start"]).orderBy("window_start").first()
    exact = sorted(v for o, t, v in rows if o == "b" and v is not None and t < START + dt.timedelta(minutes=1))
    assert small.calls == len(exact) and small.p50_ms == exact[-(-len(exact) // 2) - 1]


def test_a_window_without_values(spark):
    df = spark.createDataFrame([("a", START, None)], "operation string, ts timestamp, latency_ms double")
    row = jobs.sketch_percentiles(jobs.latency_sketches(df), ["operation"]).first()
    assert (row.calls, row.min_ms, row.p50_ms, row.max_ms) == (0, None, None, None)


@pytest.mark.parametrize("buckets", [1, 3])
def test_clients_share_buckets_of_state(spark, requests, tmp_path, buckets, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", buckets)
    schema = write_files(spark, requests, str(tmp_path / "in"), 4, [2, 0, 3, 1])
    limited(ordered.end_of_input(spark.createDataFrame(requests, REQUEST))).coalesce(1).write.parquet(str(tmp_path / "in" / "99"))
    with ordered.rocksdb_state(spark):
        out = jobs.run_available(ordered.rate_limit_in_order(jobs.read_stream(spark, str(tmp_path / "in" / "*"), schema, 1), "4000 seconds"),
                                 str(tmp_path / "out"), str(tmp_path / "cp"))
    assert decisions(out) == brute(requests, 4, 150)
