"""Exponential smoothing with additive trend and season, all settings of a grid side by side.

A series is folded once, value by value, with every setting a place in an array: level, trend, season and squared error
move together, and at each wanted cut-off the setting with the least error stays. Where a fit starts depends on the cut-off
only through the seasonal pattern of the values before it, and the fold is linear in that pattern; so it also carries how
each state answers to a change of the pattern, from which the state and error at any cut-off follow. One pass thus serves
all cut-offs of a series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.fits import SEASON

# Smoothing of the level, and of trend and season; the first of equally good settings counts.
LEVEL_RATES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)
SLOW_RATES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
FIT = "array<struct<cut:int,level:double,trend:double,pattern:array<double>,sse:double,seasonal:boolean>>"


def _pattern(y: np.ndarray, season: int) -> np.ndarray:
    """Mean of each place in the season over the whole seasons, each taken about its own mean."""
    cycles = y[:len(y) // season * season].reshape(-1, season)
    return (cycles - cycles.mean(axis=1, keepdims=True)).mean(axis=0)


def _plain(y: np.ndarray, cuts: list[int]) -> list[tuple]:
    """Fits without a season at ascending cut-offs of two or more values."""
    a, b = (x.ravel() for x in np.meshgrid(LEVEL_RATES, SLOW_RATES, indexing="ij"))
    trend = np.full(len(a), y[1] - y[0])
    level, sse, out = y[0] - trend, np.zeros(len(a)), []
    for t in range(cuts[-1]):
        error = y[t] - (level + trend)
        level, trend, sse = level + trend + a * error, trend + a * b * error, sse + error * error
        if t + 1 in cuts:
            i = int(sse.argmin())
            out.append((t + 1, level[i], trend[i], [0.0], sse[i], False))
    return out


def _seasonal(y: np.ndarray, cuts: list[int], m: int) -> list[tuple]:
    """Fits with a season of ``m`` at ascending cut-offs of two seasons or more."""
    a, b, g = (x.ravel() for x in np.meshgrid(LEVEL_RATES, SLOW_RATES, SLOW_RATES, indexing="ij"))
    size, start = len(a), _pattern(y[:cuts[-1]], m)
    first = y[:m].mean()
    trend = np.full(size, (y[m:2 * m].mean() - first) / m)
    level, sse = first - trend * (m + 1) / 2, np.zeros(size)
    pattern = np.tile(start, (size, 1))
    many = len(cuts) > 1  # with one cut-off the fold starts from its very pattern
    if many:
        level_by, trend_by = np.zeros((size, m)), np.zeros((size, m))
        pattern_by = np.tile(np.eye(m), (size, 1, 1))
        cross, square = np.zeros((size, m)), np.zeros((size, m, m))
    out = []
    for t in range(cuts[-1]):
        k = t % m
        error = y[t] - (level + trend + pattern[:, k])
        if many:
            by = level_by + trend_by + pattern_by[:, k]
            cross += error[:, None] * by
            square += by[:, :, None] * by[:, None, :]
            level_by = level_by + trend_by - a[:, None] * by
            trend_by = trend_by - (a * b)[:, None] * by
            pattern_by[:, k] -= (g * (1 - a))[:, None] * by
        level, trend = level + trend + a * error, trend + a * b * error
        pattern[:, k] += g * (1 - a) * error
        sse = sse + error * error
        if t + 1 in cuts:
            order = [(t + 1 + j) % m for j in range(m)]  # that of the next step first
            if t + 1 == cuts[-1]:
                i = int(sse.argmin())
                out.append((t + 1, level[i], trend[i], pattern[i, order].tolist(), sse[i], True))
                continue
            moved = _pattern(y[:t + 1], m) - start
            here = sse - 2 * cross @ moved + np.einsum("sij,i,j->s", square, moved, moved)
            i = int(here.argmin())
            out.append((t + 1, level[i] + level_by[i] @ moved, trend[i] + trend_by[i] @ moved,
                        (pattern[i] + pattern_by[i] @ moved)[order].tolist(), here[i], True))
    return out


def fit_at(y: np.ndarray, cuts: list[int], season: int = SEASON) -> list[dict]:
    """The best setting for the values before each cut-off, in order of cut-off."""
    cuts = sorted(set(cuts))
    short, long = [c for c in cuts if 2 <= c < 2 * season], [c for c in cuts if c >= 2 * season]
    found = [(1, y[0], 0.0, [0.0], 0.0, False)] if 1 in cuts else []
    found += _plain(y, short) if short else []
    found += _seasonal(y, long, season) if long else []
    names = ("cut", "level", "trend", "pattern", "sse", "seasonal")
    return [dict(zip(names, (c, float(le), float(tr), p, float(e), s))) for c, le, tr, p, e, s in found]


def smooth_at(arrays: DataFrame, cuts: Column, season: int = SEASON) -> DataFrame:
    """One row per series and cut-off: adds ``cut``, ``fit`` and ``status`` as of :func:`smooth`.

    ``cuts`` is an array of numbers of values. The values of a series go to a task once.
    """
    @F.pandas_udf(FIT)
    def fits(ys: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([fit_at(np.asarray(y, dtype=float), [int(c) for c in w], season) for y, w in zip(ys, wanted)])

    # Fits take their time from the processor, not from bytes, so partitions follow the series.
    tasks = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = arrays.withColumn("_cuts", cuts).repartition(tasks, "series_id")
    rows = rows.withColumn("_fit", F.explode(fits("y", "_cuts"))).drop("_cuts")
    n, f = F.col("_fit.cut"), F.col("_fit")
    size = F.when(f["seasonal"], 5 + season).otherwise(4)
    aic = n * F.log(F.greatest(f["sse"], F.lit(1e-12)) / n) + 2 * size
    fit = F.struct(f["level"].alias("level"), f["trend"].alias("trend"), f["pattern"].alias("pattern"), f["sse"].alias("sse"), aic.alias("aic"))
    status = F.when(f["seasonal"], "fitted").otherwise("no season: less than two seasons of values")
    return rows.select("*", n.alias("cut"), fit.alias("fit"), status.alias("status")).drop("_fit")


def smooth(arrays: DataFrame, season: int = SEASON) -> DataFrame:
    """Adds ``fit``, a struct of level, trend, pattern (that of the next step first), sse and aic, and ``status``.

    ``arrays`` has one row per ``series_id`` with ``y``. A series of less than two seasons is
    fitted without one, and its status says so.
    """
    return smooth_at(arrays, F.array(F.size("y")), season).drop("cut")


def ahead(fit: Column, step: Column) -> Column:
    """The forecast so many steps after the last value."""
    return fit["level"] + step * fit["trend"] + F.get(fit["pattern"], F.pmod(step - 1, F.size(fit["pattern"])))
