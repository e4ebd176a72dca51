"""Sliding-window rate limits over tables of requests.

A request is admitted when fewer than ``limit`` admitted requests of its key, a client and a
class of limit, lie in the ``window`` before it. Whether one is admitted depends on those before it, so a key is walked in
time order; a key with many requests is cut into time slices that are walked side by side and
hand their last admitted times on until nothing changes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.session import cut_lineage

# Fixed values: (requests, window in seconds) per class of endpoint.
DEFAULT_LIMITS = {
    "api": (100, 60),
    "query": (30, 60),
    "auth": (10, 300),
    "forecast": (20, 60),
    "financial": (20, 60),
    "report_schedule": (10, 60),
}
SLICE_ROWS = 200_000


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def with_limits(events: DataFrame, limit_class: str = "limit_class",
                limits: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Adds ``limit`` and ``window_seconds``; given limits override the defaults, unknown classes stay null."""
    table = {**DEFAULT_LIMITS, **(limits or {})}
    values = F.create_map(*[x for name, (n, w) in table.items()
                            for x in (F.lit(name), F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")))])
    found = F.try_element_at(values, F.col(limit_class))
    return events.withColumn("limit", found["n"]).withColumn("window_seconds", found["w"])


def walk(times: np.ndarray, limit: int, window: int, before: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Admission, remaining and reset of sorted request times, after the admitted times ``before``."""
    held = deque(before)
    n = len(times)
    admitted, remaining = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int32)
    reset = np.full(n, window // 1_000_000, dtype=np.int32)
    for i, now in enumerate(times.tolist()):
        while held and held[0] <= now - window:
            held.popleft()
        if len(held) >= limit:
            wait = (held[0] + window - now) // 1_000_000 if held else window // 1_000_000
            reset[i] = max(wait, 1)
        else:
            remaining[i] = limit - len(held) - 1
            admitted[i] = True
            held.append(now)
    last = int(times[-1]) if n else 0
    return admitted, remaining, reset, [t for t in held if t > last - window]


def limit_key(events: DataFrame, key: str = "client_key", limit_class: str = "limit_class") -> Column:
    """What a limit counts by: the client, within the class of limit where rows name one."""
    named = F.col(limit_class) if limit_class in events.columns else F.lit(None)
    return F.concat_ws("\u0001", F.coalesce(named.cast("string"), F.lit("")), F.col(key).cast("string"))


def _sliced(events: DataFrame, key: str, id_: str, ts: str, slice_rows: int) -> DataFrame:
    """Requests as (_key, _id, _us, _slice); keys beyond ``slice_rows`` are cut by time."""
    base = events.select(limit_key(events, key).alias("_key"), F.col(id_).alias("_id"), micros(ts).alias("_us"),
                         F.col("limit").cast("int").alias("_limit"),
                         (F.col("window_seconds").cast("bigint") * 1_000_000).alias("_window"))
    spans = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    busy = spans.where(F.col("_n") > slice_rows).select(
        "_key", "_from", F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_n") / F.lit(slice_rows))).alias("_width"))
    cut = base.join(busy, "_key", "left")
    return cut.withColumn("_slice", F.coalesce(F.floor((F.col("_us") - F.col("_from")) / F.col("_width")), F.lit(-1)).cast("bigint")) \
        .drop("_from", "_width")


def _in_order(requests: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Requests laid out slice by slice in time order, each slice led by the admitted times it starts with."""
    rows = requests.select("_key", "_slice", "_us", "_id", "_limit", "_window", F.lit(False).alias("_given"))
    if starts is not None:
        rows = rows.unionByName(starts.select(
            "_key", "_slice", F.explode("_before").alias("_us"), F.lit("0").cast(rows.schema["_id"].dataType).alias("_id"),
            F.lit(0).alias("_limit"), F.lit(0).cast("bigint").alias("_window"), F.lit(True).alias("_given")))
    return rows.repartition("_key", "_slice").sortWithinPartitions("_key", "_slice", F.desc("_given"), "_us", "_id")


class _Walk:
    """Walks a partition's batches in order; a slice may span batches."""

    def __init__(self) -> None:
        self.name: tuple | None = None
        self.held: list[int] = []

    def batch(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[tuple, list[int]]]]:
        """Decisions of one batch, and the admitted times at the end of each slice in it."""
        keys, slices, times, given = (rows[c].to_numpy() for c in ("_key", "_slice", "_us", "_given"))
        limits, windows = rows["_limit"].to_numpy(), rows["_window"].to_numpy()
        admitted = np.zeros(len(rows), dtype=bool)
        remaining, reset = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=np.int32)
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])) + 1
        ends = []
        for low, high in zip([0, *edges], [*edges, len(rows)]):
            name = (keys[low], slices[low])
            if name != self.name:
                self.name, self.held = name, []
            first = low + int(given[low:high].sum())  # handed-over times lead their slice
            self.held = [*self.held, *times[low:first].tolist()]
            if first < high:
                admitted[first:high], remaining[first:high], reset[first:high], self.held = walk(
                    times[first:high], int(limits[first]), int(windows[first]), self.held)
            ends.append((name, self.held))
        return admitted, remaining, reset, ends


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = _Walk()
    for rows in batches:
        if not rows.empty:
            admitted, remaining, reset, _ends = state.batch(rows)
            asked = ~rows["_given"].to_numpy()
            yield pd.DataFrame({"_id": rows["_id"].to_numpy()[asked], "admitted": admitted[asked],
                                "remaining": remaining[asked], "reset_seconds": reset[asked]})


def _last_admitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = _Walk()
    done: dict[tuple, list[int]] = {}
    for rows in batches:
        if not rows.empty:
            done.update(state.batch(rows)[3])
    if done:
        yield pd.DataFrame({"_key": [k for k, _s in done], "_slice": [s for _k, s in done], "_new": list(done.values())})


def _hand_over(sliced: DataFrame) -> DataFrame | None:
    """Admitted times each slice of a busy key starts with: (_key, _slice, _before).

    Every slice is first walked as if nothing came before it; a slice whose start turns out
    different is walked again, until all starts hold.
    """
    busy = sliced.where(F.col("_slice") >= 0)
    if busy.isEmpty():
        return None
    end_schema = T.StructType([T.StructField("_key", sliced.schema["_key"].dataType), T.StructField("_slice", T.LongType()),
                               T.StructField("_new", T.ArrayType(T.LongType()))])
    none = F.array().cast("array<bigint>")
    frames = cut_lineage(busy.groupBy("_key", "_slice").agg(F.min("_us").alias("_first"), F.max("_window").alias("_window"))
                         .withColumn("_before", none).withColumn("_end", none).withColumn("_stale", F.lit(True)))
    while True:
        stale = frames.where("_stale").select("_key", "_slice", "_before")
        again = busy.join(stale.select("_key", "_slice"), ["_key", "_slice"], "left_semi")
        ends = _in_order(again, stale).mapInPandas(_last_admitted, end_schema)
        # A key has one row per slice here, and a slice stands for many requests.
        previous = F.lag("_end").over(Window.partitionBy("_key").orderBy("_slice"))
        carried = F.filter(F.coalesce(previous, none), lambda t: t > F.col("_first") - F.col("_window"))
        frames = cut_lineage(
            frames.join(ends, ["_key", "_slice"], "left").withColumn("_end", F.coalesce("_new", "_end")).drop("_new")
            .withColumn("_start", carried).withColumn("_stale", F.col("_start") != F.col("_before"))
            .withColumn("_before", F.col("_start")).drop("_start"))
        if frames.where("_stale").isEmpty():
            return frames.select("_key", "_slice", "_before")


def rate_limit(events: DataFrame, key: str = "client_key", ts: str = "ts", id_: str = "event_id",
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The decision on each request: (id, admitted, remaining, reset_seconds).

    ``events`` has limit and window_seconds, the same for all requests of a client and class.
    Requests of a class with no limit are admitted. Equal times are taken in id order.
    """
    limited = events.where(F.col("limit").isNotNull())
    sliced = cut_lineage(_sliced(limited, key, id_, ts, slice_rows))  # every round reads it
    schema = T.StructType([T.StructField("_id", sliced.schema["_id"].dataType), T.StructField("admitted", T.BooleanType()),
                           T.StructField("remaining", T.IntegerType()), T.StructField("reset_seconds", T.IntegerType())])
    decided = _in_order(sliced, _hand_over(sliced)).mapInPandas(_decide, schema)
    free = events.where(F.col("limit").isNull()).select(
        F.col(id_).alias("_id"), F.lit(True).alias("admitted"), F.lit(0).alias("remaining"), F.lit(0).alias("reset_seconds"))
    return decided.unionByName(free).withColumnRenamed("_id", id_)


def usage(events: DataFrame, window_seconds: int, key: str = "client_key", ts: str = "ts", id_: str = "event_id",
          stretch: int = 8, admitted: DataFrame | None = None) -> DataFrame:
    """Requests of the key in the window up to each request: (id, usage).

    With ``admitted``, a log of the requests that were let through (``key`` and ``ts``), their number in the same window is
    ``admitted_usage``; log and requests are one sequence, over which a single frame sums each apart. A request counts up
    at its time and down a window later, so each count is a running sum and costs the same however many requests a window
    holds. Time is cut into slices of ``stretch`` windows. A slice also receives the last window of the slice before it, so
    each sum is complete inside its slice and no window function ever holds a whole key.
    """
    window = window_seconds * 1_000_000
    width = window * stretch
    base = events.select(F.col(key).alias("_key"), F.col(id_), micros(ts).alias("_us"), F.lit(1).alias("_asked"))
    if admitted is not None:
        base = base.unionByName(admitted.select(
            F.col(key).alias("_key"), F.lit(None).cast(events.schema[id_].dataType).alias(id_), micros(ts).alias("_us"),
            F.lit(0).alias("_asked")))
    own = F.floor(F.col("_us") / F.lit(width))
    tail = F.floor((F.col("_us") + F.lit(window - 1)) / F.lit(width))
    spread = (base.withColumn("_own", own)
              .withColumn("_slice", F.explode(F.array_distinct(F.array(own, tail)))))
    steps = F.explode(F.array(F.struct(F.col("_us").alias("at"), F.lit(1).alias("n")),
                              F.struct((F.col("_us") + window).alias("at"), F.lit(-1).alias("n"))))
    # What counts down after the end of a slice has no request there to be counted for.
    counted = spread.withColumn("_step", steps).where(
        (F.col("_step.n") == 1) | (F.floor(F.col("_step.at") / F.lit(width)) == F.col("_slice")))
    frame = Window.partitionBy("_key", "_slice").orderBy("_step.at").rangeBetween(Window.unboundedPreceding, 0)
    counts = {"usage": F.sum(F.col("_step.n") * F.col("_asked")).over(frame)}
    if admitted is not None:
        counts["admitted_usage"] = F.sum(F.col("_step.n") * (1 - F.col("_asked"))).over(frame)
    return (counted.select("*", *[c.alias(name) for name, c in counts.items()])
            .where((F.col("_slice") == F.col("_own")) & (F.col("_asked") == 1) & (F.col("_step.n") == 1)).select(id_, *counts))
