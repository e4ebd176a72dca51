"""Forecasts, order selection and backtests for many series at once.

A series is one row of arrays, and a task fits the rows of its partition one by one; the
parallelism is over series, candidate orders and cut-off dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import fits
from ledgerlight.functions.formats import grouped
from ledgerlight.operators import smoothing
from ledgerlight.operators import timeseries as ts

# Names a request may give, and the model each stands for; any other name takes the additive one.
MODELS = {"additive": "additive", "prophet": "additive", "arima": "arima", "ets": "ets", "naive": "naive"}
POINTS = ("series_id string, model string, step int, ds date, label string, yhat double, yhat_lower double, "
          "yhat_upper double, aic double, bic double, p int, d int, q int, status string")
# The range a fit may leave a failed candidate with: it is never chosen.
NO_FIT = float("inf")


def _one(model: str, dates: list, y: np.ndarray, future: list, order: tuple | None, confidence: float, holidays: bool) -> dict:
    """Forecast of one series as columns."""
    periods = len(future)
    extra: dict = {}
    if model == "arima":
        fit, extra = fits.fit_arima(y, order) if order else None, {"status": "fitted"}
        for other in (fits.DEFAULT_ORDER, (0, 1, 0)):
            if fit is None:
                fit, extra = fits.fit_arima(y, other), {"status": f"order {other}: no fit of the one chosen"}
        if fit is None:
            yhat = low = high = np.full(periods, float(np.mean(y)))
            extra = {"status": "mean of the values: no order fits"}
        else:
            yhat, low, high = fits.predict_arima(y, fit, periods, confidence)
            extra |= {"aic": fit["aic"], "bic": fit["bic"], **dict(zip("pdq", fit["order"]))}
    elif model == "naive":
        back = min(fits.SEASON, len(y))
        yhat = low = high = np.array([y[len(y) - back + i % back] for i in range(periods)])
    else:
        yhat, low, high = fits.fit_additive(dates, y, future, confidence, holidays)
    return {"status": "fitted", "yhat": yhat, "yhat_lower": low, "yhat_upper": high, **extra}


def _points(confidence: float, holidays: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.strip().split()[0] for c in POINTS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                order = None if row.order is None else tuple(int(v) for v in row.order)
                cols = _one(row.model, list(row.ds), np.asarray(row.y, dtype=float), list(row.future), order, confidence, holidays)
                steps = np.arange(1, len(row.future) + 1)
                out.append(pd.DataFrame({"series_id": row.series_id, "model": row.model, "step": steps, "ds": list(row.future),
                                         "label": [f"Period_{i}" for i in steps], **cols}))
            if out:
                yield pd.concat(out).reindex(columns=names)

    return run


def select_order(df: DataFrame, candidates: tuple = fits.CANDIDATE_ORDERS) -> DataFrame:
    """(series_id, order, aic) with the least AIC; (1, 1, 1) where no candidate fits.

    Every series is unfolded into its candidates, each fitted on its own row.
    """
    return _select(ts.to_arrays(ts.interpolate_time(df)), candidates)


def _select(arrays: DataFrame, candidates: tuple = fits.CANDIDATE_ORDERS) -> DataFrame:
    orders = F.array(*[F.array(*map(F.lit, o)) for o in candidates])
    rows = arrays.select("series_id", "y", F.explode(orders).alias("order"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "order")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            aic = []
            for y, order in zip(batch["y"], batch["order"]):
                try:
                    fit = fits.fit_arima(np.asarray(y, dtype=float), tuple(int(v) for v in order))
                except np.linalg.LinAlgError:
                    fit = None
                aic.append(fit["aic"] if fit else NO_FIT)
            yield pd.DataFrame({"series_id": batch["series_id"], "order": batch["order"], "aic": aic})

    scored = rows.mapInPandas(score, "series_id string, `order` array<int>, aic double")
    # Equal AIC goes to the order that comes first.
    best = F.min_by("order", F.struct("aic", "order"))
    aic = F.min("aic")
    chosen = F.when(aic < F.lit(NO_FIT), best).otherwise(F.array(*map(F.lit, fits.DEFAULT_ORDER)))
    return scored.groupBy("series_id").agg(chosen.alias("order"), F.when(aic < F.lit(NO_FIT), aic).alias("aic"))


def _fit(arrays: DataFrame, confidence: float, holidays: bool, order: tuple | None) -> DataFrame:
    """Points for rows of (series_id, model, ds, y, future), orders selected where needed."""
    fixed = F.array(*map(F.lit, order)) if order else F.lit(None).cast("array<int>")
    arrays = arrays.withColumn("series_id", F.col("series_id").cast("string"))
    if order is None:
        wanted = arrays.where(F.col("model") == "arima")
        orders = _select(wanted).select("series_id", "order")
        arrays = arrays.join(orders, "series_id", "left")
    else:
        arrays = arrays.withColumn("order", fixed)
    models = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    known = F.coalesce(F.try_element_at(models, F.col("model")), F.lit("additive"))
    # Fits take their time from the processor, not from bytes, so partitions follow the series.
    tasks = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = arrays.withColumn("model", known).select("series_id", "model", "ds", "y", "future", "order")
    others = named.where("model != 'ets'").repartition(tasks, "series_id").mapInPandas(_points(confidence, holidays), POINTS)
    return others.unionByName(_smoothed(named.where("model = 'ets'")))


def _smoothed(arrays: DataFrame) -> DataFrame:
    """Points of exponential smoothing, with bounds a tenth off."""
    steps = smoothing.smooth(arrays).select("series_id", "model", "fit", "status", F.posexplode("future").alias("_pos", "ds"))
    yhat = smoothing.ahead(F.col("fit"), F.col("_pos") + 1)
    points = steps.select("*", yhat.alias("yhat"))
    ends = [F.col("yhat") * 0.9, F.col("yhat") * 1.1]
    none = F.lit(None)
    return points.select(
        "series_id", "model", (F.col("_pos") + 1).alias("step"), "ds", F.concat(F.lit("Period_"), (F.col("_pos") + 1).cast("string")).alias("label"),
        "yhat", F.least(*ends).alias("yhat_lower"), F.greatest(*ends).alias("yhat_upper"), F.col("fit.aic").alias("aic"),
        none.cast("double").alias("bic"), *[none.cast("int").alias(c) for c in "pdq"], "status")


def forecast(df: DataFrame, freq: str, periods: int, model: str = "additive", confidence: float = 0.95,
             holidays: bool = False, order: tuple | None = None, models: DataFrame | None = None) -> DataFrame:
    """The next ``periods`` of every series: step, date, label, yhat with bounds, fit figures.

    ``models`` (series_id, model) picks a model per series; unknown names take the additive one.
    Series are put on their grid first, and gaps between known values are filled in time.
    """
    arrays = ts.to_arrays(ts.interpolate_time(ts.as_freq(df, freq)))
    if models is None:
        arrays = arrays.withColumn("model", F.lit(model))
    else:
        arrays = arrays.join(models.select("series_id", "model"), "series_id", "left").withColumn("model", F.coalesce("model", F.lit(model)))
    future = ts.future_grid(F.element_at("ds", -1), freq, periods)
    return _fit(arrays.withColumn("future", future), confidence, holidays, order)


def forecast_ets(df: DataFrame, freq: str, periods: int) -> DataFrame:
    return forecast(df, freq, periods, "ets")


def forecast_arima(df: DataFrame, freq: str, periods: int, order: tuple | None = None, confidence: float = 0.95) -> DataFrame:
    return forecast(df, freq, periods, "arima", confidence, order=order)


def forecast_additive(df: DataFrame, freq: str, periods: int, confidence: float = 0.95, holidays: bool = False) -> DataFrame:
    return forecast(df, freq, periods, "additive", confidence, holidays)


def _held_out(arrays: DataFrame, model: str, confidence: float, holidays: bool, order: tuple | None) -> DataFrame:
    """Forecast beside actual for rows of (series_id, ds, y, cut): train up to the cut, test after it."""
    cut = F.col("cut")
    split = arrays.select(
        "series_id", F.lit(model).alias("model"), F.slice("ds", F.lit(1), cut).alias("ds"), F.slice("y", F.lit(1), cut).alias("y"),
        F.slice("ds", cut + 1, F.col("horizon")).alias("future"), F.slice("y", cut + 1, F.col("horizon")).alias("actuals"))
    predicted = _fit(split.drop("actuals"), confidence, holidays, order).select(
        "series_id", "step", "ds", F.col("yhat").alias("predicted"), "yhat_lower", "yhat_upper")
    actual = split.select(F.col("series_id").cast("string").alias("series_id"), F.posexplode("actuals").alias("_pos", "actual"))
    return predicted.join(actual.withColumn("step", F.col("_pos") + 1).drop("_pos"), ["series_id", "step"])


def backtest(df: DataFrame, model: str = "additive", test_periods: int = 6, confidence: float = 0.95,
             holidays: bool = False, order: tuple | None = None) -> DataFrame:
    """Actual and predicted of the last ``test_periods``, for series with three more periods than that.

    ``df`` has a row for every period; gaps are filled in time.
    """
    arrays = ts.to_arrays(ts.interpolate_time(df)).where(F.size("y") >= test_periods + 3)
    arrays = arrays.withColumn("cut", F.size("y") - test_periods).withColumn("horizon", F.lit(test_periods))
    return _held_out(arrays, model, confidence, holidays, order)


def _rolling_smooth(arrays: DataFrame, cuts: Column, periods: int) -> DataFrame:
    """Actual and predicted after every cut-off, from one pass over each series."""
    fitted = smoothing.smooth_at(arrays, cuts)
    steps = fitted.select("series_id", "cut", "fit", "y", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    return steps.select("series_id", "cut", F.get("y", F.col("cut") + F.col("step") - 1).alias("actual"),
                        smoothing.ahead(F.col("fit"), F.col("step")).alias("predicted"))


def rolling_backtest(df: DataFrame, model: str = "additive", periods: int = 6, order: tuple | None = None) -> DataFrame:
    """Mean errors per series over rolling cut-offs; zeros for series shorter than two horizons.

    Cut-offs run back from one horizon before the end by half a horizon, and every training
    part keeps at least one horizon. Exponential smoothing serves all cut-offs from one pass; other models are fitted
    anew for each.
    """
    arrays = ts.to_arrays(ts.interpolate_time(df)).withColumn("series_id", F.col("series_id").cast("string"))
    step = max(periods // 2, 1)
    cuts = F.sequence(F.size("y") - periods, F.lit(periods), F.lit(-step))
    long = arrays.where(F.size("y") >= 2 * periods)
    if MODELS.get(model) == "ets":
        points = _rolling_smooth(long, cuts, periods)
    else:
        # Each cut-off is a series of its own while it is fitted.
        rows = (long.select("series_id", "ds", "y", F.explode(cuts).alias("cut")).withColumn("horizon", F.lit(periods))
                .withColumn("series_id", F.concat_ws("\u0001", "series_id", F.col("cut").cast("string"))))
        held = _held_out(rows, model, 0.95, False, order)
        points = held.withColumn("cut", F.split_part("series_id", F.lit("\u0001"), F.lit(2)).cast("int")) \
            .withColumn("series_id", F.split_part("series_id", F.lit("\u0001"), F.lit(1)))
    per_cut = ts.forecast_errors(points, ("series_id", "cut"))
    means = per_cut.groupBy("series_id").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "mape")], F.count(F.lit(1)).alias("cutoffs"))
    return arrays.select("series_id").join(means, "series_id", "left").fillna(0.0, ["mae", "rmse", "mape"]).fillna(0, ["cutoffs"])


def explain_forecast(points: DataFrame, freq: str, confidence: float = 0.95, errors: DataFrame | None = None) -> DataFrame:
    """One text per series: model, horizon, next value, direction and errors."""
    first, last = F.min_by("yhat", "step"), F.max_by("yhat", "step")
    per = points.groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"), last.alias("_last"))
    if errors is not None:
        per = per.join(errors.select("series_id", "mae", "rmse"), "series_id", "left")
    lines = [
        F.concat(F.upper("model"), F.lit(" forecast for "), F.col("_n").cast("string"), F.lit(f" periods ({freq}).")),
        F.concat(F.lit("Next period prediction: "), grouped("_first"), F.lit(".")),
        F.concat(F.lit("Overall trend: "), F.when((F.col("_n") > 1) & (F.col("_last") > F.col("_first")), "increasing").otherwise("decreasing"), F.lit(".")),
    ]
    if errors is not None:
        lines += [F.concat(F.lit("Backtest MAE: "), grouped("mae")), F.concat(F.lit("Backtest RMSE: "), grouped("rmse"))]
    lines.append(F.lit(f"{int(confidence * 100)}% confidence intervals provided."))
    return per.select("series_id", "model", F.concat_ws("\n", *lines).alias("explanation"))
