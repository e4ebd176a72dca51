"""Rate limits on a stream whose requests arrive out of order.

Requests wait in state until the watermark has passed them; no earlier one can come then, and they are walked in time
order. A timer on event time wakes them when the earliest waiting request is due.

State is kept by bucket of keys, not by key: a key of a few requests would cost as many calls to the state store as a
bucket with thousands, and there are as many keys as clients. What comes in one batch waits as one packed table, for each
row of state has such a price too.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlight.operators.rate_limit import limit_key, micros, walk

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of keys that share state and a timer.
BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


_WAITING = pa.schema([("_key", pa.string()), ("_us", pa.int64()), ("_id", pa.string()), ("_limit", pa.int32()), ("_window", pa.int64())])


def _packed(requests: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(requests[_WAITING.names], _WAITING, preserve_index=False, safe=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WAITING) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(body).read_all().to_pandas()


class _InOrder(StatefulProcessor):
    """Per bucket: ``waiting``, requests the watermark has not passed, and ``held``, admitted times of one window by key."""

    def __init__(self, columns: list[str], out: list[str], whole: bool):
        self.columns, self.out, self.whole = columns, out, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.held = handle.getValueState("held", T.StructType([
            T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("windows", T.ArrayType(T.LongType())),
            T.StructField("times", T.ArrayType(T.ArrayType(T.LongType())))]))

    def _order(self, rows: pd.DataFrame) -> np.ndarray:
        """Places of requests by key, time, then id, in the order of its own type; those without one come first."""
        named = rows["_id"].notna().to_numpy()
        ids = rows["_id"].where(named, "0" if self.whole else "")
        turn = ids.astype("int64").to_numpy() if self.whole else pd.factorize(ids, sort=True)[0]
        return np.lexsort((turn, named, rows["_us"].to_numpy(), pd.factorize(rows["_key"], sort=True)[0]))

    def _decided(self, ids: Any, admitted: Any, remaining: Any, reset: Any) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.out, (ids, admitted, np.asarray(remaining, np.int32), np.asarray(reset, np.int32)))))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch.columns = self.columns  # they come without names
            free = batch["_limit"].isna().to_numpy()
            if free.any():  # a class without a limit
                n = int(free.sum())
                yield self._decided(batch["_id"].to_numpy()[free], np.ones(n, bool), np.zeros(n), np.zeros(n))
            mine = batch[~free]
            if len(mine):
                self.waiting.appendValue((_packed(mine),))
                self.handle.registerTimer(int(mine["_us"].min()) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        tables = [_unpacked(bytes(row[0])) for row in self.waiting.get()]
        if not tables:  # an earlier timer has decided them
            return
        waiting = pd.concat(tables, ignore_index=True)
        over = (waiting["_us"] <= passed).to_numpy()
        due, left = waiting[over], waiting[~over]
        if due.empty:
            return
        due = due.iloc[self._order(due)]
        held = {}
        if self.held.exists():
            held = {k: (w, list(t)) for k, w, t in zip(*self.held.get())}
        keys, times = due["_key"].to_numpy(), due["_us"].to_numpy()
        limits, windows = due["_limit"].to_numpy(), due["_window"].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(due)]
        decided = []
        for low, high in zip(edges, edges[1:]):
            name, window = str(keys[low]), int(windows[low])
            *decision, after = walk(times[low:high], int(limits[low]), window, held.get(name, (0, []))[1])
            decided.append(decision)
            held[name] = (window, [int(t) for t in after])
        # A key whose admitted times no later request can still count is forgotten.
        kept = [(k, w, t) for k, (w, t) in held.items() if t and t[-1] > passed - w]
        self.held.update(tuple(list(part) for part in zip(*kept)) if kept else ([], [], []))
        if len(left):
            self.waiting.put([(_packed(left),)])
            self.handle.registerTimer(int(left["_us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        yield self._decided(due["_id"].to_numpy(), *(np.concatenate(part) for part in zip(*decided)))

    def close(self) -> None:
        pass


def rate_limit_in_order(requests: DataFrame, delay: str, key: str = "client_key", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Admission decisions on a stream of requests with ``limit`` and ``window_seconds``, in time order.

    Equal to :func:`ledgerlight.operators.rate_limit.rate_limit` over all requests that come at most ``delay`` after a
    later one; what comes later than that is dropped, for its turn is over. A decision is given when the watermark passes
    its request; a bucket of keys holds the requests of ``delay`` and the admitted times of one window. Requests of a class
    without a limit are admitted at once. Start it inside :func:`rocksdb_state`.
    """
    stream = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    # Ids travel as text: a column of numbers with a null among them would reach the processor as fractions.
    base = stream.select(limit_key(stream, key).alias("_key"), F.col(id_).cast("string").alias("_id"), micros(ts).alias("_us"),
                         F.col(ts).alias("_ts"), F.col("limit").cast("int").alias("_limit"),
                         (F.col("window_seconds").cast("bigint") * 1_000_000).alias("_window"))
    kind = requests.schema[id_].dataType
    out = T.StructType([T.StructField(id_, T.StringType()), T.StructField("admitted", T.BooleanType()),
                        T.StructField("remaining", T.IntegerType()), T.StructField("reset_seconds", T.IntegerType())])
    # Requests without a limit need no state, so they are dealt out however few clients sent them.
    dealt = F.when(F.col("_limit").isNull(), F.xxhash64("_id")).otherwise(F.xxhash64("_key"))
    decided = base.withColumn("_bucket", F.pmod(dealt, F.lit(BUCKETS))).groupBy("_bucket").transformWithStateInPandas(_InOrder([*base.columns, "_bucket"], out.names, isinstance(kind, T.IntegralType)), out,
                                                               "Append", "EventTime")
    return decided.withColumn(id_, F.col(id_).cast(kind))


def end_of_input(events: DataFrame, ts: str = "ts", after: str = "3650 days") -> DataFrame:
    """One row long after all events, to put at the end of a finished input: it moves the watermark past the last of them.

    All columns but the time are null.
    """
    kind = events.schema[ts].dataType
    last = events.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).cast(kind).alias(ts))
    return last.select(*[F.col(ts) if c.name == ts else F.lit(None).cast(c.dataType).alias(c.name) for c in events.schema])
