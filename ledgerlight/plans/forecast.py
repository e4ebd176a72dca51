"""Series of order totals per priority and status: grids, gaps, forecasts and backtests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerlight.operators import forecast as fc
from ledgerlight.operators import smoothing
from ledgerlight.operators import timeseries as ts
from ledgerlight.plans.registry import query

DAILY_SQL = """
daily AS (SELECT o_orderpriority || '|' || o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS ds, ROUND(SUM(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
spans AS (SELECT series_id, MIN(ds) AS lo, MAX(ds) AS hi FROM daily GROUP BY 1),
days AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM spans)
"""
MONTHLY_SQL = """
mon AS (SELECT o_orderpriority || '|' || o_orderstatus AS series_id, last_day(CAST(o_orderdate AS DATE)) AS ds, ROUND(SUM(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS i, COUNT(*) OVER (PARTITION BY series_id) AS n FROM mon)
"""

ON_GRID = {
    "D": "true",
    "W": "dayofweek(ds) = 0",
    "M": "ds = last_day(ds)",
    "Q": "ds = last_day(ds) AND month(ds) % 3 = 0",
    "Y": "ds = last_day(ds) AND month(ds) = 12",
}


def orders_series(t):
    key = F.concat_ws("|", "o_orderpriority", "o_orderstatus")
    return ts.extract_series(t.orders, "o_orderdate", "o_totalprice", key)


def daily(t):
    return orders_series(t).groupBy("series_id", "ds").agg(F.round(F.sum("y"), 2).alias("y"))


def monthly(t):
    return ts.resample(orders_series(t), "M", "sum").withColumn("y", F.round("y", 2))


@query("flt14_extract_series", """
SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) >= 3)
""")
def extracted(t):
    return ts.extract_series(t.orders, "o_orderdate", "o_totalprice", F.col("o_custkey").cast("string"))


@query("ts1_regular_grid", "WITH " + DAILY_SQL + " UNION ALL ".join(
    f"SELECT '{f}' AS freq, series_id, ds, ROUND(y, 2) AS y FROM days LEFT JOIN daily USING (series_id, ds) WHERE {test}" for f, test in ON_GRID.items()))
def grid(t):
    series = daily(t)
    parts = [ts.as_freq(series, f).withColumn("y", F.round("y", 2)).withColumn("freq", F.lit(f)) for f in ts.FREQUENCIES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("jn4_calendar_join", "WITH " + DAILY_SQL + """
SELECT series_id, ds, ROUND(y, 2) AS y FROM days LEFT JOIN daily USING (series_id, ds)
""")
def calendar(t):
    return ts.as_freq(daily(t), "D").withColumn("y", F.round("y", 2))


@query("ts1b_bucketed_grid", """
WITH raw AS (SELECT o_orderpriority || '|' || o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS y FROM orders),
b AS (
  SELECT 'W' AS freq, series_id, CAST(date_trunc('week', d) AS DATE) + 6 AS ds, SUM(y) AS y FROM raw GROUP BY ALL
  UNION ALL SELECT 'M', series_id, last_day(d), SUM(y) FROM raw GROUP BY ALL
  UNION ALL SELECT 'Q', series_id, last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTHS AS DATE)), SUM(y) FROM raw GROUP BY ALL)
SELECT freq, series_id, CAST(ds AS DATE) AS ds, ROUND(y, 2) AS y FROM b
""")
def bucketed(t):
    series = orders_series(t)
    parts = [ts.resample(series, f).where(F.col("y").isNotNull()).withColumn("y", F.round("y", 2)).withColumn("freq", F.lit(f)) for f in ("W", "M", "Q")]
    return reduce(lambda a, b: a.unionByName(b), parts)


FILLED_SQL = "WITH " + DAILY_SQL + """
, g AS (SELECT series_id, ds, y FROM days LEFT JOIN daily USING (series_id, ds)),
m AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS d0, last_value(y IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER a AS d1, first_value(y IGNORE NULLS) OVER a AS y1 FROM g
  WINDOW b AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ds, ROUND(coalesce(y, y0 + (y1 - y0) * ((ds - d0) / (d1 - d0)), y0), 6) AS y FROM m
"""


@query("ts2_interpolation", FILLED_SQL)
def interpolated(t):
    return ts.interpolate_time(ts.as_freq(daily(t), "D")).withColumn("y", F.round("y", 6))


@query("ts2_interpolation_in_blocks", FILLED_SQL)
def interpolated_in_blocks(t):
    """The same with every series laid out and filled in stretches of ninety days."""
    return ts.interpolate_time(ts.as_freq(daily(t), "D", block_days=90), 90).withColumn("y", F.round("y", 6))


@query("ts3_frequency", """
WITH d AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds FROM orders),
g AS (SELECT series_id, ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS gap FROM d),
m AS (SELECT series_id, median(gap) AS median_days FROM g GROUP BY series_id)
SELECT series_id, median_days, CASE WHEN median_days IS NULL THEN 'M' WHEN median_days <= 1 THEN 'D' WHEN median_days <= 7 THEN 'W'
  WHEN median_days <= 31 THEN 'M' WHEN median_days <= 92 THEN 'Q' ELSE 'A' END AS freq FROM m
""")
def frequency(t):
    return ts.infer_freq(t.orders.select(F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderdate").cast("date").alias("ds")))


@query("ts9_future_calendar", """
WITH last AS (SELECT o_orderpriority AS series_id, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1),
days AS (SELECT series_id, CAST(unnest(generate_series(CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, CAST(hi AS TIMESTAMP) + INTERVAL 9 YEARS, INTERVAL 1 DAY)) AS DATE) AS ds FROM last),
""" + "al AS (" + " UNION ALL ".join(f"SELECT '{f}' AS freq, series_id, ds FROM days WHERE {test}" for f, test in ON_GRID.items()) + """)
SELECT freq, series_id, ds, CAST(row_number() OVER (PARTITION BY freq, series_id ORDER BY ds) AS INTEGER) AS step,
  'Period_' || row_number() OVER (PARTITION BY freq, series_id ORDER BY ds) AS label FROM al QUALIFY step <= 6
""")
def future(t):
    series = t.orders.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ds"))
    parts = [ts.future_dates(series, f, 6).withColumn("freq", F.lit(f)) for f in ts.FREQUENCIES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("ts11_forecast_errors", """
SELECT event_type AS series_id, ROUND(AVG(abs(a - p)), 6) AS mae, ROUND(sqrt(AVG((a - p) * (a - p))), 6) AS rmse,
  ROUND(coalesce(AVG(CASE WHEN a <> 0 THEN abs((a - p) / a) END) * 100, 0), 6) AS mape
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS a, value AS p FROM events) GROUP BY event_type
""")
def errors(t):
    rows = t.events.select(F.col("event_type").alias("series_id"), F.get_json_object("props", "$.k").cast("double").alias("actual"),
                           F.col("value").alias("predicted"))
    out = ts.forecast_errors(rows)
    return out.select("series_id", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape")])


@query("ts14_baselines", "WITH " + MONTHLY_SQL + """
, f AS (SELECT series_id, MAX(n) AS n, MAX(ds) AS last_ds, arg_max(y, i) AS last_y, arg_min(y, i) AS first_y FROM numbered GROUP BY series_id),
h AS (SELECT f.*, CAST(unnest(range(1, 13)) AS INTEGER) AS step FROM f)
SELECT h.series_id, step, CAST(last_day(CAST(last_ds + to_months(step) AS DATE)) AS DATE) AS ds, ROUND(m.y, 2) AS seasonal_naive,
  ROUND(last_y + (last_y - first_y) / (h.n - 1) * step, 6) AS drift
FROM h JOIN numbered m ON m.series_id = h.series_id AND m.i = h.n - least(12, h.n) + (step - 1) % least(12, h.n) + 1
""")
def baselines(t):
    out = ts.forecast_naive(monthly(t), "M", 12)
    return out.withColumn("seasonal_naive", F.round("seasonal_naive", 2)).withColumn("drift", F.round("drift", 6))


@query("ts10_backtest_naive", "WITH " + MONTHLY_SQL + """
SELECT t.series_id, CAST(t.i - (t.n - 6) AS INTEGER) AS step, t.ds, ROUND(t.y, 2) AS actual, ROUND(s.y, 2) AS predicted
FROM numbered t JOIN numbered s ON s.series_id = t.series_id AND s.i = t.n - 6 - least(12, t.n - 6) + (t.i - (t.n - 6) - 1) % least(12, t.n - 6) + 1
WHERE t.i > t.n - 6 AND t.n >= 9
""")
def naive_backtest(t):
    out = fc.backtest(monthly(t), "naive")
    return out.select("series_id", "step", "ds", F.round("actual", 2).alias("actual"), F.round("predicted", 2).alias("predicted"))


def ets_sql(train: str, ahead: int) -> str:
    """CTEs that fit ``train`` (key, y list, n) and give ``points`` (key, step, yhat, sse, n)."""
    rates, slow = (str(list(r)) for r in (smoothing.LEVEL_RATES, smoothing.SLOW_RATES))
    return f"""
train AS ({train}),
shape AS (SELECT *, list_avg(y[1:m]) AS first, CASE WHEN n >= 2 * m THEN (list_avg(y[m + 1:2 * m]) - list_avg(y[1:m])) / m ELSE 0 END AS trend,
  CASE WHEN m = 1 THEN [CAST(0 AS DOUBLE)] ELSE [list_avg([y[c * 12 + k] - list_avg(y[c * 12 + 1 : c * 12 + 12]) FOR c IN range(0, n // 12)]) FOR k IN range(1, 13)] END AS pattern
  FROM (SELECT *, CASE WHEN n >= 24 THEN 12 ELSE 1 END AS m FROM train)),
grid AS (SELECT a, b, g, row_number() OVER (ORDER BY a, b, g) AS place
  FROM (SELECT unnest({rates}) AS a), (SELECT unnest({slow}) AS b), (SELECT unnest({slow}) AS g)),
fold AS (
  SELECT key, m, place, a, b, g, CAST(0 AS BIGINT) AS i, CAST(first - CASE WHEN m = 1 THEN trend ELSE trend * 13 / 2 END AS DOUBLE) AS level,
    CAST(trend AS DOUBLE) AS trend, pattern, CAST(0 AS DOUBLE) AS sse FROM shape, grid WHERE m > 1 OR g = 0
  UNION ALL
  SELECT key, m, place, a, b, g, i + 1, level + trend + a * e, trend + a * b * e, list_append(pattern[2:m], pattern[1] + g * (1 - a) * e), sse + e * e
  FROM (SELECT f.*, s.y[f.i + 1] - (f.level + f.trend + f.pattern[1]) AS e FROM fold f JOIN shape s ON s.key = f.key AND f.i < s.n)),
best AS (SELECT f.* FROM fold f JOIN shape s ON s.key = f.key AND f.i = s.n QUALIFY row_number() OVER (PARTITION BY f.key ORDER BY sse, place) = 1),
points AS (SELECT key, step, level + step * trend + pattern[(step - 1) % m + 1] AS yhat, sse, i AS n
  FROM (SELECT *, unnest(range(1, {ahead + 1})) AS step FROM best))"""


@query("ts4_ets", "WITH RECURSIVE " + MONTHLY_SQL + ", " + ets_sql(
    "SELECT series_id AS key, list(y ORDER BY i) AS y, max(n) AS n FROM numbered GROUP BY series_id", 12) + """
SELECT key AS series_id, CAST(step AS INTEGER) AS step, CAST(last_day(CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE)) AS DATE) AS ds,
  ROUND(yhat, 2) AS yhat, ROUND(least(yhat * 0.9, yhat * 1.1), 2) AS yhat_lower, ROUND(greatest(yhat * 0.9, yhat * 1.1), 2) AS yhat_upper,
  ROUND(p.n * ln(sse / p.n) + 34, 4) AS aic, 'fitted' AS status
FROM points p JOIN (SELECT series_id, max(ds) AS last_ds FROM numbered GROUP BY series_id) ON key = series_id
""")
def ets(t):
    out = fc.forecast_ets(monthly(t), "M", 12)
    return out.select("series_id", "step", "ds", *[F.round(c, 2).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")],
                      F.round("aic", 4).alias("aic"), "status")


@query("ts5_arima")
def arima(t):
    return fc.forecast_arima(monthly(t), "M", 12)


@query("ts6_order_selection")
def orders_chosen(t):
    return fc.select_order(monthly(t))


@query("ts7_additive")
def additive(t):
    return fc.forecast_additive(monthly(t), "M", 12, holidays=True)


@query("ts8_model_dispatch")
def dispatch(t):
    series = monthly(t)
    model = F.element_at(F.array(*map(F.lit, ("ets", "arima", "prophet", "unheard_of"))),
                         F.pmod(F.xxhash64("series_id"), F.lit(4)).cast("int") + 1)
    return fc.forecast(series, "M", 6, models=series.select("series_id").distinct().withColumn("model", model))


TWO_MODELS_SQL = """
SELECT f.key AS series_id, 'ets' AS model, CAST(f.step AS INTEGER) AS step, CAST(last_day(CAST(l.ds + to_months(CAST(f.step AS INTEGER)) AS DATE)) AS DATE) AS ds,
  'Period_' || f.step AS label, ROUND(yhat, 2) AS yhat FROM points f JOIN numbered l ON l.series_id = f.key AND l.i = l.n WHERE length(f.key) % 2 = 0
UNION ALL
SELECT l.series_id, 'naive', CAST(step AS INTEGER), CAST(last_day(CAST(l.ds + to_months(CAST(step AS INTEGER)) AS DATE)) AS DATE), 'Period_' || step, ROUND(m.y, 2)
FROM (SELECT *, unnest(range(1, 7)) AS step FROM numbered WHERE i = n AND length(series_id) % 2 = 1) l
JOIN numbered m ON m.series_id = l.series_id AND m.i = l.n - least(12, l.n) + (step - 1) % least(12, l.n) + 1
"""


@query("ts8_dispatch_two_models", "WITH RECURSIVE " + MONTHLY_SQL + ", " + ets_sql(
    "SELECT series_id AS key, list(y ORDER BY i) AS y, max(n) AS n FROM numbered GROUP BY series_id", 6) + TWO_MODELS_SQL)
def two_models(t):
    """Every series by the model it is given, here by the length of its name."""
    series = monthly(t)
    model = F.when(F.char_length("series_id") % 2 == 0, "ets").otherwise("naive")
    out = fc.forecast(series, "M", 6, models=series.select("series_id").distinct().withColumn("model", model))
    return out.select("series_id", "model", "step", "ds", "label", F.round("yhat", 2).alias("yhat"))


@query("ts10_backtest", "WITH RECURSIVE " + MONTHLY_SQL + ", " + ets_sql(
    "SELECT series_id AS key, list(y ORDER BY i) AS y, max(n) - 6 AS n FROM numbered WHERE i <= n - 6 GROUP BY series_id", 6) + """
SELECT series_id, ROUND(AVG(abs(m.y - yhat)), 2) AS mae, ROUND(sqrt(AVG((m.y - yhat) * (m.y - yhat))), 2) AS rmse,
  ROUND(coalesce(AVG(CASE WHEN m.y <> 0 THEN abs((m.y - yhat) / m.y) END) * 100, 0), 4) AS mape
FROM points p JOIN numbered m ON m.series_id = p.key AND m.i = p.n + step GROUP BY series_id
""")
def held_out(t):
    out = ts.forecast_errors(fc.backtest(monthly(t), "ets"))
    return out.select("series_id", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape", 4).alias("mape"))


@query("ts12_rolling_backtest", "WITH RECURSIVE " + MONTHLY_SQL + """
, cuts AS (SELECT series_id, unnest(range(max(n) - 12, 11, -6)) AS cut FROM numbered GROUP BY series_id HAVING max(n) >= 24),
""" + ets_sql("""SELECT {'s': series_id, 'cut': cut} AS key, list(y ORDER BY i) AS y, cut AS n
  FROM numbered JOIN cuts USING (series_id) WHERE i <= cut GROUP BY series_id, cut""", 12) + """
, per AS (SELECT p.key.s AS series_id, p.key.cut AS cut, AVG(abs(m.y - yhat)) AS mae, sqrt(AVG((m.y - yhat) * (m.y - yhat))) AS rmse,
    coalesce(AVG(CASE WHEN m.y <> 0 THEN abs((m.y - yhat) / m.y) END) * 100, 0) AS mape
  FROM points p JOIN numbered m ON m.series_id = p.key.s AND m.i = p.key.cut + step GROUP BY ALL)
SELECT s.series_id, ROUND(coalesce(AVG(mae), 0), 2) AS mae, ROUND(coalesce(AVG(rmse), 0), 2) AS rmse, ROUND(coalesce(AVG(mape), 0), 4) AS mape,
  COUNT(cut) AS cutoffs FROM (SELECT DISTINCT series_id FROM numbered) s LEFT JOIN per USING (series_id) GROUP BY s.series_id
""")
def rolling(t):
    out = fc.rolling_backtest(monthly(t), "ets", 12)
    return out.select("series_id", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape", 4).alias("mape"), "cutoffs")


@query("ts13_forecast_summary", "WITH RECURSIVE " + MONTHLY_SQL + ", " + ets_sql(
    """SELECT {'s': series_id, 'held': held} AS key, list(y ORDER BY i) AS y, max(n) - held AS n
  FROM numbered, (SELECT unnest([0, 6]) AS held) WHERE i <= n - held GROUP BY series_id, held""", 12) + """
, e AS (SELECT p.key.s AS series_id, AVG(abs(m.y - yhat)) AS mae, sqrt(AVG((m.y - yhat) * (m.y - yhat))) AS rmse
  FROM points p JOIN numbered m ON m.series_id = p.key.s AND m.i = p.n + step WHERE p.key.held = 6 AND step <= 6 GROUP BY 1),
f AS (SELECT key.s AS series_id, arg_min(yhat, step) AS next, arg_max(yhat, step) AS last FROM points WHERE key.held = 0 GROUP BY 1)
SELECT series_id, 'ets' AS model, 'ETS forecast for 12 periods (M).' || E'\\nNext period prediction: ' || format('{:,.2f}', next) || '.' ||
  E'\\nOverall trend: ' || CASE WHEN last > next THEN 'increasing' ELSE 'decreasing' END || '.' ||
  E'\\nBacktest MAE: ' || format('{:,.2f}', mae) || E'\\nBacktest RMSE: ' || format('{:,.2f}', rmse) ||
  E'\\n95% confidence intervals provided.' AS explanation FROM f JOIN e USING (series_id)
""")
def explained(t):
    series = monthly(t)
    errors = ts.forecast_errors(fc.backtest(series, "ets"))
    return fc.explain_forecast(fc.forecast_ets(series, "M", 12), "M", errors=errors)
