"""Regular grids, gaps, calendars and error measures for tables of many series.

A series table has ``series_id``, ``ds`` (date) and ``y``. After :func:`as_freq` or
:func:`resample` a series has one row per period, so whatever is gathered or ordered per series
is bounded by the calendar and not by the transactions behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS = 3
FREQUENCIES = ("D", "W", "M", "Q", "Y")


def extract_series(df: DataFrame, date: str, metric: str, key: str | Column | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """(series_id, ds, y) of every series with at least ``min_rows`` rows.

    Row counts come from their own partial aggregate, so a long series is never held whole.
    """
    series = F.lit("all") if key is None else (F.col(key) if isinstance(key, str) else key)
    rows = df.select(series.alias("series_id"), F.col(date).cast("date").alias("ds"), F.col(metric).cast("double").alias("y"))
    enough = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    return rows.join(enough.select("series_id"), "series_id", "left_semi")


def period_end(ds: Column | str, freq: str) -> Column:
    """Last day of the period a date lies in; weeks end on Sunday."""
    d = F.col(ds) if isinstance(ds, str) else ds
    if freq == "D":
        return d
    if freq == "W":
        return F.next_day(F.date_sub(d, 1), "Sun")
    if freq == "M":
        return F.last_day(d)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    if freq == "Y":
        return F.last_day(F.add_months(F.trunc(d, "year"), 11))
    raise ValueError(f"unknown frequency: {freq}")


def grid_between(first: Column, last: Column, freq: str) -> Column:
    """Array of the period ends from ``first`` to ``last``."""
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS", "Y": "INTERVAL 1 YEAR"}[freq]
    if freq in ("D", "W"):
        start, stop = period_end(first, freq), last
    else:
        unit = {"M": "month", "Q": "quarter", "Y": "year"}[freq]
        start, stop = F.trunc(first, unit), F.trunc(last, unit)
    days = F.when(start <= stop, F.sequence(start, stop, F.expr(step)))
    return F.filter(F.transform(days, lambda d: period_end(d, freq)), lambda d: (d >= first) & (d <= last))


def calendar(df: DataFrame, freq: str, block_days: int | None = None) -> DataFrame:
    """(series_id, ds) for every period end between a series' first and last date.

    With ``block_days`` a span is laid out in stretches of so many days, which tasks share.
    """
    spans = df.groupBy("series_id").agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"))
    if block_days:
        starts = F.sequence("_first", "_last", F.expr(f"INTERVAL {block_days} DAYS"))
        spans = spans.select("series_id", F.explode(starts).alias("_first"), "_last").repartition("series_id", "_first").withColumn(
            "_last", F.least("_last", F.date_add("_first", block_days - 1)))
    return spans.select("series_id", F.explode(grid_between(F.col("_first"), F.col("_last"), freq)).alias("ds"))


def doubled_days(df: DataFrame) -> DataFrame:
    """(series_id, ds, n): days on which a series has several rows, which have no place on a grid."""
    return df.groupBy("series_id", "ds").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def as_freq(df: DataFrame, freq: str, doubled: str = "error", block_days: int | None = None) -> DataFrame:
    """The series on its regular grid; only rows exactly on a grid day keep their value.

    Which of two rows of a series on one day counts is not defined: they are an error, or with ``doubled="gap"`` the day is
    a gap, and :func:`doubled_days` tells which ones are. ``block_days`` is for series of very many days.
    """
    if doubled not in ("error", "gap"):
        raise ValueError(f"doubled days are an error or a gap, not: {doubled}")
    twice = F.lit(None).cast("double") if doubled == "gap" else \
        F.raise_error(F.lit("a series has two rows on one day; resample it first")).cast("double")
    unique = df.groupBy("series_id", "ds").agg(F.count(F.lit(1)).alias("_n"), F.max("y").alias("_y"))
    unique = unique.select("series_id", "ds", F.when(F.col("_n") > 1, twice).otherwise(F.col("_y")).alias("y"))
    return calendar(df, freq, block_days).join(unique, ["series_id", "ds"], "left")


def resample(df: DataFrame, freq: str, agg: str = "sum") -> DataFrame:
    """One row per period with the sum or mean of its rows, null where it has none."""
    fn = {"sum": F.sum, "avg": F.avg}[agg]
    buckets = df.groupBy("series_id", period_end("ds", freq).alias("ds")).agg(fn("y").alias("y"))
    return calendar(buckets, freq).join(buckets, ["series_id", "ds"], "left")


def _filled(marked: DataFrame) -> DataFrame:
    """Values between the known ones ``_before`` and ``_after`` of each row."""
    b, a = F.col("_before"), F.col("_after")
    share = F.date_diff(F.col("ds"), b["ds"]) / F.date_diff(a["ds"], b["ds"])
    return marked.select("series_id", "ds", F.coalesce(F.col("y"), b["y"] + (a["y"] - b["y"]) * share, b["y"]).alias("y"))


def _interpolate_blocks(df: DataFrame, block_days: int) -> DataFrame:
    """The same in blocks of time, which are filled side by side and hand their first and last known value on.

    What is ordered per series is a row per block.
    """
    known = F.when(F.col("y").isNotNull(), F.struct("ds", "y"))
    # Dealt by series and block here, or a join by series alone further up would leave a series in one task.
    rows = df.withColumn("_block", F.floor(F.unix_date("ds") / block_days)).repartition("series_id", "_block")
    blocks = rows.groupBy("series_id", "_block").agg(F.min(known).alias("_least"), F.max(known).alias("_most"))
    earlier = Window.partitionBy("series_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("series_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = blocks.select("series_id", "_block", F.last("_most", ignorenulls=True).over(earlier).alias("_from"),
                          F.last("_least", ignorenulls=True).over(later).alias("_to"))
    inside = Window.partitionBy("series_id", "_block")
    back = inside.orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.orderBy(F.desc("ds")).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(edges, ["series_id", "_block"]).select(
        "series_id", "ds", "y", F.coalesce(F.last(known, ignorenulls=True).over(back), "_from").alias("_before"),
        F.coalesce(F.last(known, ignorenulls=True).over(ahead), "_to").alias("_after"))
    return _filled(marked)


def interpolate_time(df: DataFrame, block_days: int | None = None) -> DataFrame:
    """Fills gaps in proportion to time; after the last value it stays, before the first it is null.

    A series is one task's unless ``block_days`` cuts its time into blocks, for series too long for one.
    """
    if block_days:
        return _interpolate_blocks(df, block_days)
    # Both frames grow with the row; a frame that shrinks would be rebuilt for every row.
    by_series = Window.partitionBy("series_id")
    back = by_series.orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_series.orderBy(F.desc("ds")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("y").isNotNull(), F.struct("ds", "y"))
    marked = df.withColumn("_before", F.last(known, ignorenulls=True).over(back)) \
        .withColumn("_after", F.last(known, ignorenulls=True).over(ahead))
    return _filled(marked)


def infer_freq(df: DataFrame) -> DataFrame:
    """(series_id, median_days, freq) from the median gap in whole days; M for a single date."""
    from ledgerlight.operators.order_stats import median_of_counts

    days = df.select("series_id", "ds").distinct()
    gap = F.date_diff("ds", F.lag("ds").over(Window.partitionBy("series_id").orderBy("ds")))
    gaps = days.withColumn("gap", gap).where(F.col("gap").isNotNull()).groupBy("series_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    medians = median_of_counts(gaps, ["series_id"], "gap").withColumnRenamed("median", "median_days")
    m = F.col("median_days")
    freq = (F.when(m.isNull(), "M").when(m <= 1, "D").when(m <= 7, "W").when(m <= 31, "M").when(m <= 92, "Q").otherwise("A"))
    return days.select("series_id").distinct().join(medians, "series_id", "left").withColumn("freq", freq)


def future_grid(last: Column, freq: str, periods: int) -> Column:
    """Array of the ``periods`` grid days after ``last``."""
    if freq in ("D", "W"):
        days = {"D": 1, "W": 7}[freq]
        start = period_end(F.date_add(last, 1), freq)
        return F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda i: F.date_add(start, i * days))
    months = {"M": 1, "Q": 3, "Y": 12}[freq]
    start = period_end(F.date_add(last, 1), freq)
    return F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda i: F.last_day(F.add_months(start, i * months)))


def future_dates(df: DataFrame, freq: str, periods: int) -> DataFrame:
    """(series_id, step, ds, label) for the next ``periods`` of every series."""
    last = df.groupBy("series_id").agg(F.max("ds").alias("_last"))
    return (last.select("series_id", F.posexplode(future_grid(F.col("_last"), freq, periods)).alias("_pos", "ds"))
            .select("series_id", (F.col("_pos") + 1).alias("step"), "ds",
                    F.concat(F.lit("Period_"), (F.col("_pos") + 1).cast("string")).alias("label")))


def forecast_errors(df: DataFrame, by: tuple[str, ...] = ("series_id",), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean absolute, root mean squared and mean absolute percentage error; zero actuals do not count in the last."""
    gap = F.col(actual) - F.col(predicted)
    share = F.when(F.col(actual) != 0, F.abs(gap / F.col(actual)))
    return df.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
                               F.coalesce(F.avg(share) * 100, F.lit(0.0)).alias("mape"))


def to_arrays(df: DataFrame) -> DataFrame:
    """One row per series: (series_id, ds array, y array), in date order.

    For series on a grid, where the arrays hold one value per period.
    """
    gathered = (df.where(F.col("y").isNotNull()).groupBy("series_id")
                .agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("_s")))
    return gathered.select("series_id", F.transform("_s", lambda s: s["ds"]).alias("ds"),
                           F.transform("_s", lambda s: s["y"]).alias("y"))


def forecast_naive(df: DataFrame, freq: str, periods: int, season: int = 12) -> DataFrame:
    """Two baselines per step: last season's value, and the straight line from first to last.

    Series are put on their grid first, and gaps between known values are filled in time.
    """
    arrays = to_arrays(interpolate_time(as_freq(df, freq)))
    n = F.size("y")
    back = F.least(F.lit(season), n)
    last, first = F.element_at("y", -1), F.element_at("y", 1)
    slope = F.when(n > 1, (last - first) / (n - 1)).otherwise(0.0)
    steps = arrays.select(
        "series_id", "y", n.alias("_n"), back.alias("_back"), last.alias("_last"), slope.alias("_slope"),
        F.posexplode(future_grid(F.element_at("ds", -1), freq, periods)).alias("_pos", "ds"))
    at = F.col("_n") - F.col("_back") + F.pmod(F.col("_pos"), F.col("_back")) + 1
    return steps.select("series_id", (F.col("_pos") + 1).alias("step"), "ds", F.element_at("y", at).alias("seasonal_naive"),
                        (F.col("_last") + F.col("_slope") * (F.col("_pos") + 1)).alias("drift"))
