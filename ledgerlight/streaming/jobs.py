"""Structured Streaming forms of the rate limit, the audit log and the telemetry."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlight.operators.rate_limit import limit_key, micros, walk
from ledgerlight.operators.telemetry import PERCENTILES
from ledgerlight.session import ensure_checkpoint_dir

AUDIT_TRIGGER = "5 seconds"
AUDIT_GROUP = 100
TELEMETRY_WINDOW = "15 seconds"
SKETCH_K = 800  # a sketch of at most this many values has them all


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder or glob, in the order they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, reachable by every executor."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Appends everything that has arrived to Parquet and reads it back."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    run = writer.trigger(availableNow=True).start(path)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def rate_limit_stream(requests: DataFrame, key: str = "client_key", ts: str = "ts", id_: str = "event_id",
                      idle: str | None = None) -> DataFrame:
    """Admission decisions on a stream of requests with ``limit`` and ``window_seconds``.

    Limits count by client and class; requests of a class with no limit are admitted. The state of a key is its admitted times of one window, at most ``limit`` of them; with
    ``idle``, a watermark delay, keys that went quiet are forgotten. Requests are walked in
    time order inside a batch; across batches files must arrive in time order. Where they do not, see
    :func:`ledgerlight.streaming.ordered.rate_limit_in_order`.
    """
    stream = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, idle) if idle else requests
    base = stream.select(limit_key(stream, key).alias("_key"), F.col(id_).alias("_id"), micros(ts).alias("_us"), F.col(ts).alias("_ts"),
                         F.col("limit").cast("int").alias("limit"),
                         (F.col("window_seconds").cast("bigint") * 1_000_000).alias("_window"))
    out = T.StructType([T.StructField("_id", base.schema["_id"].dataType), T.StructField("admitted", T.BooleanType()),
                        T.StructField("remaining", T.IntegerType()), T.StructField("reset_seconds", T.IntegerType())])
    held = T.StructType([T.StructField("times", T.ArrayType(T.LongType())), T.StructField("window", T.LongType())])

    def decide(_key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["_us", "_id"])
        if rows["limit"].isna().all():  # a class without a limit
            yield pd.DataFrame({"_id": rows["_id"].to_numpy(), "admitted": True, "remaining": np.int32(0), "reset_seconds": np.int32(0)})
            return
        before = list(state.get[0]) if state.exists else []
        window = int(rows["_window"].iloc[0])
        admitted, remaining, reset, after = walk(rows["_us"].to_numpy(), int(rows["limit"].iloc[0]), window, before)
        state.update(([int(t) for t in after], window))
        if idle:
            until = max(after[-1] if after else 0, int(rows["_us"].max())) // 1000 + window // 1000
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"_id": rows["_id"].to_numpy(), "admitted": admitted,
                            "remaining": remaining.astype(np.int32), "reset_seconds": reset.astype(np.int32)})

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return base.groupBy("_key").applyInPandasWithState(decide, out, held, "append", timeout) \
        .withColumnRenamed("_id", id_)


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit events as stored: a missing timestamp becomes the time of arrival, and a day to file them under."""
    stamped = F.coalesce(F.col("timestamp"), F.current_timestamp().cast(events.schema["timestamp"].dataType))
    return events.withColumn("timestamp", stamped).withColumn("day", stamped.cast("date"))


def audit_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Appends audit events to Parquet every five seconds, each exactly once across restarts."""
    writer = (audit_rows(events).writeStream.format("parquet").outputMode("append").partitionBy("day")
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=AUDIT_TRIGGER)
    return writer.start(path)


def audit_groups_stream(events: DataFrame, path: str, checkpoint: str, resent_within: str = "1 hour",
                        group_rows: int = AUDIT_GROUP, event_id: str = "event_id", available_now: bool = False):
    """Appends audit events every five seconds in files of at most ``group_rows``, each event once.

    An event that is sent again up to ``resent_within`` after its arrival is dropped. Time of arrival is the watermark, so
    no event is ever too late to be stored, whatever its own timestamp. A batch has a folder of its own, which a replay
    after a failure replaces, so it adds nothing.
    """
    arrived = audit_rows(events).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", resent_within)
    once = arrived.dropDuplicatesWithinWatermark([event_id])

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", group_rows).parquet(f"{path}/batch={batch_id}")

    writer = once.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=AUDIT_TRIGGER)).start()


def telemetry_stream(events: DataFrame, ts: str = "ts", window: str = TELEMETRY_WINDOW, delay: str = "1 minute") -> DataFrame:
    """Calls, errors, tokens and latency per operation and tumbling window.

    Events later than ``delay`` are dropped; a window is written once the watermark passes it.
    Over a table of finished input it gives every window, see :func:`with_open_windows`.
    """
    kind = events.schema[ts].dataType
    return (events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .groupBy(F.window(ts, window).alias("w"), "operation")
            .agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"),
                 F.sum("total_tokens").alias("tokens"), F.avg("latency_ms").alias("avg_ms"),
                 F.max("latency_ms").alias("max_ms"))
            .select(F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), "operation",
                    "calls", "errors", "tokens", "avg_ms", "max_ms"))


def latency_sketches(events: DataFrame, ts: str = "ts", window: str = TELEMETRY_WINDOW, delay: str = "1 minute",
                     by: Sequence[str] = ("operation",), value: str = "latency_ms", k: int = SKETCH_K) -> DataFrame:
    """A quantile sketch of the latencies of each group and tumbling window.

    The state of a window is one sketch of a few times ``k`` values however many events it has. Sketches of short windows
    can be merged into those of longer ones, see :func:`sketch_percentiles`.
    """
    kind = events.schema[ts].dataType
    return (events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .groupBy(F.window(ts, window).alias("w"), *by)
            .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
            .select(F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), *by, "sketch"))


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of a sketch's quantile may be off, as a share of the values, with 99 % confidence."""
    return 2.296 / k**0.9723


def sketch_percentiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float] = PERCENTILES, k: int = SKETCH_K) -> DataFrame:
    """Merges sketches by group: calls, the least and greatest value, and the percentiles, within :func:`rank_error`.

    Up to ``k`` values the sketch has them all and the percentiles are exact. Null where a group has no values.
    """
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    n = F.kll_sketch_get_n_double("sketch")

    def at(p: float):
        return F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))

    return merged.select(*by, n.alias("calls"), at(0.0).alias("min_ms"),
                         *[at(p).alias(f"p{round(p * 100)}_ms") for p in probs], at(1.0).alias("max_ms"))


def with_open_windows(written: DataFrame, events: DataFrame, windows: Callable[..., DataFrame] = telemetry_stream,
                      **options: str) -> DataFrame:
    """What a stream of ``windows`` wrote, and the windows that were still open when its input ended.

    ``events`` is the finished input as a table.
    """
    return written.unionByName(windows(events, **options).join(written, ["window_start", "operation"], "left_anti")
                               .select(*written.columns))
