import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import fits
from ledgerlight.operators import forecast as fc
from ledgerlight.operators import timeseries as ts


def month_end(i):
    year, month = 2020 + (i + 1) // 12, (i + 1) % 12 + 1
    return dt.date(year, month, 1) - dt.timedelta(days=1)


@pytest.fixture(scope="module")
def monthly(spark):
    rng = random.Random(42)
    rows = [(s, month_end(i), level + 2.0 * i + 20 * math.sin(2 * math.pi * i / 12) + rng.gauss(0, 1))
            for s, level in (("a", 100.0), ("b", 300.0)) for i in range(60)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def series(spark, rows):
    return spark.createDataFrame([("s", dt.date.fromisoformat(d), y) for d, y in rows], "series_id string, ds date, y double")


def test_as_freq_keeps_only_rows_on_the_grid(spark):
    df = series(spark, [("2024-01-31", 1.0), ("2024-02-15", 9.0), ("2024-04-30", 4.0), ("2024-05-02", 5.0)])
    got = [(str(r.ds), r.y) for r in ts.as_freq(df, "M").orderBy("ds").collect()]
    assert got == [("2024-01-31", 1.0), ("2024-02-29", None), ("2024-03-31", None), ("2024-04-30", 4.0)]
    assert [str(r.ds) for r in ts.as_freq(df, "W").orderBy("ds").collect()][:2] == ["2024-02-04", "2024-02-11"]
    assert [str(r.ds) for r in ts.as_freq(df, "Q").orderBy("ds").collect()] == ["2024-03-31"]


def test_two_rows_on_one_day_are_an_error(spark):
    with pytest.raises(Exception, match="two rows on one day"):
        ts.as_freq(series(spark, [("2024-01-31", 1.0), ("2024-01-31", 2.0)]), "D").collect()


def test_interpolation_follows_time(spark):
    df = series(spark, [("2024-01-01", None), ("2024-01-02", 10.0), ("2024-01-03", None), ("2024-01-06", 50.0), ("2024-01-07", None)])
    got = [r.y for r in ts.interpolate_time(df).orderBy("ds").collect()]
    assert got == [None, 10.0, 20.0, 50.0, 50.0]


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
@pytest.mark.parametrize("block_days", [1, 7, 45, 5000])
def test_blocks_do_not_change_a_series(spark, freq, block_days):
    rng = random.Random(block_days)
    start = dt.date(2020, 1, 5)
    rows = [(s, start + dt.timedelta(days=d), None if rng.random() < 0.5 else float(rng.randint(0, 99)))
            for s, n in (("a", 700), ("b", 40), ("c", 1)) for d in range(n) if rng.random() < 0.4 or d in (0, n - 1)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")

    def table(frame):
        return sorted((r.series_id, r.ds, None if r.y is None else round(r.y, 9)) for r in frame.collect())

    plain, cut = ts.as_freq(df, freq), ts.as_freq(df, freq, block_days=block_days)
    assert table(plain) == table(cut)
    assert table(ts.interpolate_time(plain)) == table(ts.interpolate_time(cut, block_days))


def test_a_million_points_in_many_tasks(spark, request):
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # which would put so little data into one task again
    spark.conf.set(key, "false")
    request.addfinalizer(lambda: spark.conf.set(key, "true"))
    days = 1_000_000
    ends = spark.sql(f"""SELECT 's' AS series_id, DATE '0001-01-01' AS ds, 0D AS y
        UNION ALL SELECT 's', date_add(DATE '0001-01-01', {days - 1}), {float(days - 1)}D""")
    filled = ts.interpolate_time(ts.as_freq(ends, "D", block_days=20_000), 20_000)
    got = filled.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max(F.abs(
        F.col("y") - F.date_diff("ds", F.expr("DATE '0001-01-01'")))).alias("off")).collect()
    assert sum(r.n for r in got) == days and len(got) > 1 and max(r.n for r in got) < days / 2 and max(r.off for r in got) < 1e-6


def test_doubled_days_may_be_gaps(spark):
    df = series(spark, [("2024-01-31", 1.0), ("2024-02-29", 7.0), ("2024-02-29", 9.0), ("2024-03-31", 3.0)])
    assert [(str(r.ds), r.n) for r in ts.doubled_days(df).collect()] == [("2024-02-29", 2)]
    assert [r.y for r in ts.as_freq(df, "M", doubled="gap").orderBy("ds").collect()] == [1.0, None, 3.0]
    with pytest.raises(ValueError):
        ts.as_freq(df, "M", doubled="first")


def test_rolling_backtest_like_single_fits(spark, monthly):
    """One pass over a series gives what a fit of its own gives for every cut-off."""
    import numpy as np

    from ledgerlight.operators import smoothing

    for n in (1, 2, 5, 23, 24, 25, 60, 61):
        y = np.array([50 + 3 * math.sin(i) + 0.4 * i + (i * 7919 % 13) for i in range(n)])
        cuts = [c for c in range(1, n + 1, 3)] + [n]
        for many, cut in zip(smoothing.fit_at(y, cuts), sorted(set(cuts))):
            alone = smoothing.fit_at(y[:cut], [cut])[0]
            assert many["cut"] == alone["cut"] == cut and many["seasonal"] == alone["seasonal"] == (cut >= 24)
            assert many["pattern"] == pytest.approx(alone["pattern"], abs=1e-8)
            assert [many[k] for k in ("level", "trend", "sse")] == pytest.approx([alone[k] for k in ("level", "trend", "sse")], rel=1e-7, abs=1e-8)


@pytest.mark.parametrize("gap, freq", [(1, "D"), (7, "W"), (30, "M"), (91, "Q"), (365, "A")])
def test_infer_freq(spark, gap, freq):
    start = dt.date(2020, 1, 1)
    df = series(spark, [(str(start + dt.timedelta(days=gap * i)), 1.0) for i in range(5)])
    assert ts.infer_freq(df).first().freq == freq
    assert ts.infer_freq(df.limit(1)).first().freq == "M"


def test_short_series_are_left_out(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0)] * 2 + [("b", "2024-01-01", 1.0)] * 3, ["k", "d", "v"])
    assert {r.series_id for r in ts.extract_series(df, "d", "v", "k").collect()} == {"b"}


def test_errors(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0), ("a", 0.0, 1.0), ("z", 0.0, 1.0)], ["series_id", "actual", "predicted"])
    got = {r.series_id: r for r in ts.forecast_errors(df).collect()}
    assert got["a"].mae == 1.5 and got["a"].rmse == pytest.approx(math.sqrt(2.5)) and got["a"].mape == pytest.approx(20.0)
    assert got["z"].mape == 0.0


@pytest.mark.parametrize("model", ["ets", "arima", "prophet", "something else"])
def test_forecast_shape(monthly, model):
    rows = fc.forecast(monthly, "M", 6, model).orderBy("series_id", "step").collect()
    assert len(rows) == 12 and [r.step for r in rows[:6]] == [1, 2, 3, 4, 5, 6]
    assert rows[0].ds == dt.date(2025, 1, 31) and rows[0].label == "Period_1"
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    assert rows[0].model == ("additive" if model in ("something else", "prophet") else model)
    if model == "ets":
        assert all(r.yhat_upper == pytest.approx(r.yhat * 1.1) and r.aic is not None for r in rows)
    if model == "arima":
        assert all(r.p is not None and r.bic is not None for r in rows)


def test_wider_confidence_gives_wider_intervals(monthly):
    def width(model, level):
        return fc.forecast(monthly, "M", 3, model, confidence=level).agg(F.sum(F.col("yhat_upper") - F.col("yhat_lower"))).first()[0]

    assert width("arima", 0.99) > width("arima", 0.8) and width("prophet", 0.99) > width("prophet", 0.8)


@pytest.mark.parametrize("model", ["ets", "prophet"])
def test_seasonal_models_beat_the_naive_one(monthly, model):
    def mae(name):
        return ts.forecast_errors(fc.backtest(monthly, name, 6)).agg(F.avg("mae")).first()[0]

    assert mae(model) < mae("naive") / 2


def test_backtest_needs_three_more_periods(monthly):
    short = monthly.where(F.col("ds") <= F.lit(month_end(7)))
    assert fc.backtest(short, "naive", 6).count() == 0 and fc.backtest(short, "naive", 5).count() == 10


def test_order_selection(monthly):
    rows = fc.select_order(monthly).collect()
    assert all(tuple(r.order) in fits.CANDIDATE_ORDERS for r in rows) and len(fits.CANDIDATE_ORDERS) == 17
    short = fc.select_order(monthly.where(F.col("ds") <= F.lit(month_end(1)))).first()
    assert tuple(short.order) == (1, 1, 1) and short.aic is None


def test_rolling_backtest(monthly):
    rows = fc.rolling_backtest(monthly, "ets", 12).collect()
    assert all(r.cutoffs == 7 and 0 < r.mae < 40 for r in rows)
    short = fc.rolling_backtest(monthly.where(F.col("ds") <= F.lit(month_end(10))), "ets", 6).first()
    assert (short.mae, short.rmse, short.mape) == (0.0, 0.0, 0.0)


def test_naive_baselines(spark):
    df = series(spark, [(str(month_end(i)), float(i)) for i in range(24)])
    rows = ts.forecast_naive(df, "M", 14).orderBy("step").collect()
    assert [r.seasonal_naive for r in rows][:2] == [12.0, 13.0] and rows[12].seasonal_naive == 12.0
    assert rows[0].drift == pytest.approx(24.0) and rows[13].drift == pytest.approx(37.0)


def test_explanation(monthly):
    points = fc.forecast_ets(monthly, "M", 6)
    errors = ts.forecast_errors(fc.backtest(monthly, "ets", 6))
    text = fc.explain_forecast(points, "M", errors=errors).first().explanation.splitlines()
    assert text[0] == "ETS forecast for 6 periods (M)." and text[-1] == "95% confidence intervals provided." and text[3].startswith("Backtest MAE: ")


def test_holidays_follow_their_rules():
    days = fits.us_holidays(2024)
    assert days["thanksgiving"] == dt.date(2024, 11, 28) and days["memorial"] == dt.date(2024, 5, 27) and days["labor"] == dt.date(2024, 9, 2)


def test_holidays_move_a_daily_forecast():
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(4 * 365)]
    names = set().union(*(fits.us_holidays(y).values() for y in range(2020, 2025)))
    y = [100.0 + (50.0 if d in names else 0.0) for d in days]
    future = [dt.date(2024, 7, 3), dt.date(2024, 7, 4)]
    yhat = fits.fit_additive(days, y, future, holidays=True)[0]
    assert yhat[1] - yhat[0] == pytest.approx(50, abs=5)


@pytest.mark.parametrize("model", ["ets", "naive"])
def test_gaps_are_filled_and_not_closed(spark, model):
    wave = [(str(month_end(i)), 100 + 50 * math.sin(2 * math.pi * i / 12)) for i in range(48)]
    whole = series(spark, wave)
    for gaps in ({5, 18, 31}, {7, 8}):
        holes = series(spark, [p for i, p in enumerate(wave) if i not in gaps])
        got, want = ([r.yhat for r in fc.forecast(d, "M", 6, model).orderBy("step").collect()] for d in (holes, whole))
        assert got == pytest.approx(want, rel=0.06)
    last_gap = series(spark, [(d, None if i == 30 else y) for i, (d, y) in enumerate(wave)])
    assert [r.step for r in fc.backtest(last_gap, "naive", 6).orderBy("step").collect()] == [1, 2, 3, 4, 5, 6]
