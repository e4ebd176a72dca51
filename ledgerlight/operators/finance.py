"""Project finance for whole tables of projects.

A project is one row with ``cf array<double>``, the index being the period. Every model is a
column over that array, so any number of projects runs in one pass with no shuffle. :func:`collect_cash_flows` builds the arrays from long rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.formats import grouped, percent, plain

# Assumptions a model takes when the request names none.
DEFAULT_ASSUMPTIONS = {
    "dcf": {
        "revenue_growth": 0.15,
        "ebitda_margin": 0.25,
        "tax_rate": 0.21,
        "discount_rate": 0.12,
        "terminal_growth": 0.03,
        "capex_pct_revenue": 0.05,
        "depreciation_pct_revenue": 0.04,
        "working_capital_pct_revenue": 0.10,
    },
    "npv": {"discount_rate": 0.10},
    "irr": {},
    "payback": {},
    "sensitivity": {"base_npv": 0.0},
}

HURDLE_RATE = 0.10
_ROOT_STEPS = 60


def _col(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def collect_cash_flows(long: DataFrame, project: str, period: str, amount: str) -> DataFrame:
    """Long rows to one array per project, periods ascending.

    Amounts are summed per (project, period) first. What is then gathered per project is one
    value per period, so its size follows the calendar and not the number of transactions.
    """
    per_period = long.groupBy(project, period).agg(F.sum(amount).alias("_cf"))
    gathered = per_period.groupBy(project).agg(
        F.array_sort(F.collect_list(F.struct(period, "_cf"))).alias("_flows"))
    return gathered.select(project, F.transform("_flows", lambda s: s["_cf"]).alias("cf"))


def npv(cf: Column | str, rate: Column | str | float) -> Column:
    """Sum of cf[i] / (1 + rate)^i, the first flow undiscounted; an empty array gives 0."""
    growth = F.lit(1.0) + _col(rate)
    return F.aggregate(F.reverse(_col(cf)), F.lit(0.0), lambda acc, x: acc / growth + x)


# Rates between which a root is looked for, closer together around zero.
_RATE_GRID = np.array(
    [-0.99, -0.95, -0.9, -0.8, -0.7] + [-0.6 + 0.05 * i for i in range(12)] + [0.025 * i for i in range(41)]
    + [1.25, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0, 100.0, 1e3, 1e4, 1e6, 1e9])


def _discounted(flows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Sum of flows[:, i] * factor^i for a column of factors per project."""
    total = np.zeros(np.broadcast_shapes((len(flows), 1), factor.shape))
    for i in range(flows.shape[1] - 1, -1, -1):
        total = total * factor + flows[:, i:i + 1]
    return total


def solve_irr(flows: np.ndarray) -> np.ndarray:
    """Rates of many projects at once; ``flows`` is padded with zeros, NaN where there is no rate."""
    factors = 1.0 / (1.0 + _RATE_GRID)[None, :]
    signs = np.sign(_discounted(flows, factors))
    crossing = (signs[:, :-1] == 0) | (signs[:, :-1] * signs[:, 1:] < 0)
    away = np.minimum(np.abs(_RATE_GRID[:-1]), np.abs(_RATE_GRID[1:]))
    at = np.argmin(np.where(crossing, away, np.inf), axis=1)
    found = crossing[np.arange(len(flows)), at]
    high, low = factors[0, at][:, None], factors[0, at + 1][:, None]
    above = signs[np.arange(len(flows)), at][:, None]
    for _ in range(_ROOT_STEPS):
        middle = (low + high) / 2
        same = np.sign(_discounted(flows, middle)) == above
        low, high = np.where(same, low, middle), np.where(same, middle, high)
    exact = above[:, 0] == 0
    rate = np.where(found, np.where(exact, 1 / factors[0, at] - 1, 2 / (low + high)[:, 0] - 1), np.nan)
    # One change of sign has one root. The grid may miss it beyond its ends, and of several roots two in one cell.
    for i in range(len(flows)):
        known = flows[i][flows[i] != 0]
        changes = int((np.sign(known[1:]) != np.sign(known[:-1])).sum())
        if changes == 0:
            rate[i] = np.nan
        elif changes > 1 or not found[i]:
            rate[i] = _nearest_root(flows[i])
    return rate


def _nearest_root(flows: np.ndarray) -> float:
    """The rate nearest zero among all positive real roots of the discounting polynomial."""
    ends = np.flatnonzero(flows)
    own = flows[ends[0]:ends[-1] + 1]  # leading zeros only delay, trailing ones add nothing
    roots = np.roots(own[::-1])
    factors = roots.real[(np.abs(roots.imag) <= 1e-6 * np.abs(roots)) & (roots.real > 0)]
    powers, rates = np.arange(len(own)), []
    for factor in factors:
        for _ in range(50):  # polish: roots of a companion matrix are good to a few digits where they lie close
            terms = own * factor ** powers
            slope = (terms[1:] * powers[1:]).sum() / factor
            step = terms.sum() / slope if slope else 0.0
            factor -= step if abs(step) < factor / 2 else np.sign(step) * factor / 2
            if abs(step) <= 1e-15 * factor:
                break
        if abs((own * factor ** powers).sum()) <= 1e-9 * np.abs(own * factor ** powers).sum():
            rates.append(1 / factor - 1)
    return min(rates, key=abs, default=np.nan)


def irr(cf: Column | str) -> Column:
    """The rate at which NPV is zero; null when there is none.

    Solved for the discount factor v = 1 / (1 + rate): NPV is a polynomial in v, and v in
    (0, inf) stands for the rates above -100 %. The factors are tried on a grid and the
    bracket nearest to rate 0 is bisected, for a whole Arrow batch at once; flows whose sign
    changes more than once, or whose root is off the grid, have all roots isolated one by one.
    Null where a flow is missing or not a number.
    """
    @F.pandas_udf(T.DoubleType())
    def rates(batch: pd.Series) -> pd.Series:
        known = batch[batch.map(lambda x: x is not None and len(x) > 0 and bool(np.isfinite(np.asarray(x, dtype=float)).all()))]
        out = pd.Series(np.full(len(batch), np.nan), index=batch.index)
        if len(known):
            # Projects of like length go together, so a long one does not pad all others.
            for _, like in known.groupby(known.map(lambda x: len(x).bit_length())):
                flows = np.zeros((len(like), max(map(len, like))))
                for i, row in enumerate(like):
                    flows[i, :len(row)] = row
                out[like.index] = solve_irr(flows)
        return out

    return F.nullif(rates(_col(cf)), F.lit(float("nan")))


def payback(cf: Column | str) -> Column:
    """Periods until the running total first reaches zero, with a linear last step."""

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + x
        hit = F.when(acc["i"] == 0, F.lit(0.0)).otherwise(
            acc["i"].cast("double") - 1 + F.abs(acc["total"]) / F.abs(x))
        return F.struct((acc["i"] + 1).alias("i"), total.alias("total"),
                        F.coalesce(acc["at"], F.when(total >= 0, hit)).alias("at"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("at"))
    return F.aggregate(_col(cf), start, step, lambda acc: acc["at"])


def dcf(cf: Column | str, rate: Column | str | float, growth: Column | str | float) -> Column:
    """Struct of pv_fcf, terminal_value, pv_terminal and dcf_value for free cash flows.

    The first flow is one period away. Null, not infinite, when the rate does not exceed the
    growth rate; zeros for an empty array.
    """
    c, r, g = _col(cf), _col(rate), _col(growth)
    n = F.size(c)
    pv = npv(c, r) / (1 + r)
    terminal = F.when(r > g, F.try_element_at(c, F.lit(-1)) * (1 + g) / (r - g))
    pv_terminal = terminal / F.pow(1 + r, n.cast("double"))
    empty = n <= 0

    def zero_if_empty(value: Column) -> Column:
        return F.when(empty, F.lit(0.0)).otherwise(value)

    return F.struct(
        zero_if_empty(pv).alias("pv_fcf"),
        zero_if_empty(terminal).alias("terminal_value"),
        zero_if_empty(pv_terminal).alias("pv_terminal"),
        zero_if_empty(pv + pv_terminal).alias("dcf_value"),
    )


def linspace(low: float, high: float, steps: int) -> list[float]:
    if steps == 1:
        return [low]
    width = (high - low) / (steps - 1)
    return [low + i * width for i in range(steps - 1)] + [high]


def sensitivity(df: DataFrame, project: str, cf: str, variables: Sequence[str],
                ranges: Mapping[str, tuple[float, float]], base_rate: Column | float = HURDLE_RATE,
                steps: int = 5) -> DataFrame:
    """NPV at each grid point of each variable, one long row per point.

    The grid is a literal array exploded on each row, so nothing is joined. Only the discount
    rate moves NPV; other variables come out flat and are marked so. Variables with no range
    are skipped.
    """
    base = _col(base_rate)
    points = [F.struct(F.lit(var).alias("variable"), F.lit(step).alias("step"), F.lit(value).alias("value"))
              for var in variables if var in ranges
              for step, value in enumerate(linspace(*map(float, ranges[var]), steps))]
    if not points:
        return df.where(F.lit(False)).select(
            project, F.lit("").alias("variable"), F.lit(0).alias("step"),
            F.lit(0.0).alias("value"), F.lit(0.0).alias("npv"), F.lit(True).alias("flat"))
    exploded = df.select(project, cf, base.alias("_base"), F.explode(F.array(*points)).alias("_p"))
    rate = F.when(F.col("_p.variable") == "discount_rate", F.col("_p.value")).otherwise(F.col("_base"))
    return exploded.select(project, "_p.variable", "_p.step", "_p.value", npv(cf, rate).alias("npv"),
                           (F.col("_p.variable") != "discount_rate").alias("flat"))


def sensitivity_table(points: DataFrame, project: str) -> DataFrame:
    """Lowest and highest NPV per project and variable."""
    return points.groupBy(project, "variable").agg(F.min("npv").alias("npv_min"), F.max("npv").alias("npv_max"))


def with_assumptions(df: DataFrame, model: str = "model_type", given: str = "assumptions",
                     defaults: Mapping[str, Mapping[str, float]] = DEFAULT_ASSUMPTIONS) -> DataFrame:
    """Adds ``assumptions_used``: the model's defaults overlaid with the given values."""
    def as_map(values: Mapping[str, float]) -> Column:
        if not values:
            return F.create_map().cast("map<string,double>")
        return F.create_map(*[F.lit(x) for pair in values.items() for x in (pair[0], float(pair[1]))])

    base = F.create_map().cast("map<string,double>")
    chosen = None
    for name, values in defaults.items():
        test = F.col(model) == name
        chosen = F.when(test, as_map(values)) if chosen is None else chosen.when(test, as_map(values))
    chosen = chosen.otherwise(base)
    own = F.coalesce(F.col(given), base)
    # Defaults that the request overrides are dropped, so keys never collide.
    kept = F.map_filter(chosen, lambda k, _v: ~F.map_contains_key(own, k))
    return df.withColumn("assumptions_used", F.map_concat(kept, own))


def sensitivity_of_request(variables: Column, ranges: Column, cf: Column, rate: Column, steps: int = 5) -> Column:
    """An array of variable and NPVs for every variable of a request that has a range there, in the request's order.

    ``ranges`` maps a variable to its ends, ``low`` and ``high``. As in :func:`sensitivity` only the discount rate moves NPV.
    """
    def points(variable: Column, ends: Column) -> Column:
        width = (ends["high"] - ends["low"]) / max(steps - 1, 1)
        values = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.when(
            (i == steps - 1) & (i > 0), ends["high"]).otherwise(ends["low"] + i * width))
        return F.transform(values, lambda v: npv(cf, F.when(variable == "discount_rate", v).otherwise(rate)))

    ranged = F.filter(variables, lambda v: F.map_contains_key(ranges, v))
    return F.transform(ranged, lambda v: F.struct(v.alias("variable"), points(v, F.element_at(ranges, v)).alias("npvs")))


def run_models(df: DataFrame, model: str = "model_type", cf: str = "cf",
               assumptions: str = "assumptions_used", low: float = 0.08, high: float = 0.15,
               steps: int = 5, variables: str | None = None, ranges: str | None = None) -> DataFrame:
    """Adds npv, irr, payback_period, dcf_value and the sensitivity table, by model type.

    A sensitivity request names its ``variables`` (an array) and their ``ranges`` (a map to low and high); one that names
    neither varies the discount rate from ``low`` to ``high``. ``sensitivity_npvs`` are the NPVs of the first variable.
    """
    m, c = F.col(model), F.col(cf)
    used = F.col(assumptions)
    rate = F.coalesce(F.try_element_at(used, F.lit("discount_rate")), F.lit(HURDLE_RATE))
    dcf_rate = F.coalesce(F.try_element_at(used, F.lit("discount_rate")), F.lit(0.12))
    growth = F.coalesce(F.try_element_at(used, F.lit("terminal_growth")), F.lit(0.03))
    usual = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))
    names, ends = F.array(F.lit("discount_rate")), F.create_map(F.lit("discount_rate"), usual)
    if variables is not None and ranges is not None:
        neither = F.col(variables).isNull() & F.col(ranges).isNull()
        names = F.when(neither, names).otherwise(F.coalesce(variables, F.array().cast("array<string>")))
        none = F.create_map().cast("map<string,struct<low:double,high:double>>")
        ends = F.when(neither, ends).otherwise(F.coalesce(F.col(ranges).cast("map<string,struct<low:double,high:double>>"), none))
    solved = (df.withColumn("irr", irr(F.when(m == "irr", c)))
              .withColumn("payback_period", F.when(m == "payback", payback(c)))
              .withColumn("dcf_value", F.when(m == "dcf", dcf(c, dcf_rate, growth)["dcf_value"]))
              .withColumn("sensitivity_table", F.when(m == "sensitivity", sensitivity_of_request(names, ends, c, rate, steps)))
              .withColumn("sensitivity_npvs", F.get("sensitivity_table", F.lit(0))["npvs"]))
    asked = (m == "npv") | ((m == "sensitivity") & (F.size("sensitivity_table") > 0))
    value = (F.when(asked, npv(c, rate))
             .when(m == "irr", npv(c, F.col("irr")))
             .when(m == "dcf", F.col("dcf_value")))
    return solved.withColumn("npv", value)


def explain_models(df: DataFrame, model: str = "model_type", assumptions: str = "assumptions_used") -> DataFrame:
    """Adds ``explanation``, one line per finding."""
    m, used = F.col(model), F.col(assumptions)
    rate = F.coalesce(F.try_element_at(used, F.lit("discount_rate")), F.lit(HURDLE_RATE))
    growth = F.coalesce(F.try_element_at(used, F.lit("terminal_growth")), F.lit(0.03))

    def lines(*parts: Column) -> Column:
        return F.array(*parts)

    npv_text = lines(
        F.concat(F.lit("NPV: $"), grouped("npv"), F.lit(" at "), percent(rate, 1), F.lit(" discount rate.")),
        F.when(F.col("npv") > 0, F.lit("Positive NPV indicates value creation."))
        .otherwise(F.lit("Negative NPV indicates value destruction.")))
    irr_text = lines(
        F.concat(F.lit("IRR: "), percent("irr"), F.lit(".")),
        F.concat(F.when(F.col("irr") > rate, F.lit("Project exceeds hurdle rate of "))
                 .otherwise(F.lit("Project below hurdle rate of ")), percent(rate, 1), F.lit(".")))
    dcf_text = lines(
        F.concat(F.lit("DCF Enterprise Value: $"), grouped("dcf_value"), F.lit(".")),
        F.concat(F.lit("Terminal growth assumption: "), percent(growth, 1), F.lit(".")))
    payback_text = lines(F.concat(F.lit("Payback Period: "), plain("payback_period"), F.lit(" years.")))
    def spread(row: Column) -> Column:
        return F.concat(row["variable"], F.lit(": NPV range $"), grouped(F.array_min(row["npvs"]), 0),
                        F.lit(" to $"), grouped(F.array_max(row["npvs"]), 0), F.lit("."))

    sens_text = F.concat(lines(F.lit("Sensitivity analysis shows NPV impact of key variables.")),
                         F.transform("sensitivity_table", spread))
    body = (F.when((m == "npv") & F.col("npv").isNotNull(), npv_text)
            .when((m == "irr") & F.col("irr").isNotNull(), irr_text)
            .when((m == "dcf") & F.col("dcf_value").isNotNull(), dcf_text)
            .when((m == "payback") & F.col("payback_period").isNotNull(), payback_text)
            .when((m == "sensitivity") & (F.size("sensitivity_table") > 0), sens_text)
            .otherwise(F.array().cast("array<string>")))
    head = F.array(F.concat(F.upper(m), F.lit(" Analysis Complete.\n")))
    return df.withColumn("explanation", F.array_join(F.concat(head, body), "\n"))


def extract_model_params(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds model_type, cash_flows, discount_rate and terminal_growth read from the text."""
    q = F.lower(F.col(text))
    model = (F.when(q.rlike("sensitiv|varying"), F.lit("sensitivity"))
             .when(q.rlike(r"\bdcf\b|discounted cash"), F.lit("dcf"))
             .when(q.rlike(r"\bnpv\b|net present"), F.lit("npv"))
             .when(q.rlike(r"\birr\b|internal rate"), F.lit("irr"))
             .when(q.rlike("payback"), F.lit("payback")))
    inner = F.regexp_extract(q, r"\[([-0-9., ]+)\]", 1)
    flows = F.when(inner != "", F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double")))
    number = r"([0-9]+(?:\.[0-9]+)?)% *"

    def rate(pattern: str) -> Column:
        found = F.regexp_extract(q, pattern, 1)
        return F.when(found != "", found.try_cast("double") / 100)

    return (questions.withColumn("model_type", model).withColumn("cash_flows", flows)
            .withColumn("discount_rate", rate(number + "discount"))
            .withColumn("terminal_growth", rate(number + "(?:terminal *)?growth")))
