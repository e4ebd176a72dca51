"""Financial models over one project per customer: yearly sales, the first year as outlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import formats
from ledgerlight.operators import finance
from ledgerlight.plans.registry import query

FLOWS_SQL = """
yearly AS (
  SELECT o_custkey AS project_id, year(o_orderdate) AS y, SUM(o_totalprice) AS amount FROM orders GROUP BY 1, 2),
flows AS (
  SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY y) - 1 AS INTEGER) AS i, amount FROM yearly),
cfl AS (
  SELECT project_id, i, CASE WHEN i = 0 THEN -amount ELSE amount END AS cf FROM flows),
arrs AS (
  SELECT project_id, list(cf ORDER BY i) AS cf FROM cfl GROUP BY project_id)
"""

# Segment of the customer -> model run on the project; fixed values.
SEGMENT_MODELS = {
    "AUTOMOBILE": "npv", "BUILDING": "irr", "FURNITURE": "dcf", "HOUSEHOLD": "payback", "MACHINERY": "sensitivity",
}

IRR_SQL = """
bis AS (
  SELECT project_id, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS step FROM arrs WHERE len(cf) > 1
  UNION ALL
  SELECT b.project_id,
    CASE WHEN list_reduce(list_reverse(list_prepend(0.0::DOUBLE, a.cf)), lambda acc, x: acc * ((b.lo + b.hi) / 2) + x) < 0
         THEN (b.lo + b.hi) / 2 ELSE b.lo END,
    CASE WHEN list_reduce(list_reverse(list_prepend(0.0::DOUBLE, a.cf)), lambda acc, x: acc * ((b.lo + b.hi) / 2) + x) < 0
         THEN b.hi ELSE (b.lo + b.hi) / 2 END,
    b.step + 1
  FROM bis b JOIN arrs a USING (project_id) WHERE b.step < 70),
irrs AS (SELECT project_id, 2 / (lo + hi) - 1 AS irr FROM bis WHERE step = 70)
"""


def projects(t):
    year = F.year("o_orderdate").alias("y")
    arrays = finance.collect_cash_flows(t.orders.select(F.col("o_custkey").alias("project_id"), year, "o_totalprice"),
                                        "project_id", "y", "o_totalprice")
    return arrays.withColumn("cf", F.transform("cf", lambda x, i: F.when(i == 0, -x).otherwise(x)))


def free_flows(t):
    return projects(t).withColumn("cf", F.transform("cf", lambda x: F.abs(x)))


@query("fin1_npv", f"""
WITH {FLOWS_SQL}
SELECT project_id, ROUND(SUM(cf / pow(1.1, i)), 2) AS npv FROM cfl GROUP BY project_id
""")
def npv(t):
    return projects(t).select("project_id", F.round(finance.npv("cf", 0.10), 2).alias("npv"))


@query("fin2_irr", f"""
WITH RECURSIVE {FLOWS_SQL}, {IRR_SQL}
SELECT a.project_id, ROUND(i.irr, 6) AS irr FROM arrs a LEFT JOIN irrs i USING (project_id)
""")
def irr(t):
    return projects(t).select("project_id", F.round(finance.irr("cf"), 6).alias("irr"))


@query("fin3_payback", f"""
WITH {FLOWS_SQL},
run AS (SELECT project_id, i, cf, SUM(cf) OVER (PARTITION BY project_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM cfl),
hit AS (SELECT project_id, arg_min(CASE WHEN i = 0 THEN 0.0 ELSE i - 1 + abs(cum - cf) / abs(cf) END, i) AS p
        FROM run WHERE cum >= 0 GROUP BY project_id)
SELECT a.project_id, ROUND(h.p, 6) AS payback_period FROM arrs a LEFT JOIN hit h USING (project_id)
""")
def payback(t):
    return projects(t).select("project_id", F.round(finance.payback("cf"), 6).alias("payback_period"))


@query("fin4_dcf", f"""
WITH {FLOWS_SQL},
v AS (
  SELECT project_id, SUM(amount / pow(1.12, i + 1)) AS pv_fcf, COUNT(*) AS n, arg_max(amount, i) AS last_fcf
  FROM flows GROUP BY project_id)
SELECT project_id, ROUND(pv_fcf, 2) AS pv_fcf, ROUND(last_fcf * 1.03 / 0.09, 2) AS terminal_value,
  ROUND(last_fcf * 1.03 / 0.09 / pow(1.12, n), 2) AS pv_terminal,
  ROUND(pv_fcf + last_fcf * 1.03 / 0.09 / pow(1.12, n), 2) AS dcf_value FROM v
""")
def dcf(t):
    valued = free_flows(t).select("project_id", finance.dcf("cf", 0.12, 0.03).alias("d"))
    return valued.select("project_id", *[F.round(f"d.{c}", 2).alias(c)
                                         for c in ("pv_fcf", "terminal_value", "pv_terminal", "dcf_value")])


@query("fin5_sensitivity", f"""
WITH {FLOWS_SQL},
grid AS (
  SELECT 'discount_rate' AS variable, CAST(s AS INTEGER) AS step, 0.08 + s * (0.15 - 0.08) / 3 AS value FROM range(4) r(s)
  UNION ALL SELECT 'terminal_growth', CAST(s AS INTEGER), 0.01 + s * (0.04 - 0.01) / 3 FROM range(4) r(s))
SELECT project_id, variable, step, ROUND(value, 6) AS value,
  ROUND(SUM(cf / pow(1 + CASE WHEN variable = 'discount_rate' THEN value ELSE 0.1 END, i)), 2) AS npv,
  variable <> 'discount_rate' AS flat
FROM cfl CROSS JOIN grid GROUP BY project_id, variable, step, value
""")
def sensitivity(t):
    points = finance.sensitivity(projects(t), "project_id", "cf",
                                 ["discount_rate", "terminal_growth", "tax_rate"],
                                 {"discount_rate": (0.08, 0.15), "terminal_growth": (0.01, 0.04)}, steps=4)
    return points.withColumn("npv", F.round("npv", 2)).withColumn("value", F.round("value", 6))


@query("jn6_sensitivity_range", f"""
WITH {FLOWS_SQL},
pts AS (
  SELECT project_id, s, SUM(cf / pow(1 + 0.08 + s * (0.15 - 0.08) / 4, i)) AS npv
  FROM cfl CROSS JOIN range(5) r(s) GROUP BY project_id, s)
SELECT project_id, 'discount_rate' AS variable, ROUND(MIN(npv), 2) AS npv_min, ROUND(MAX(npv), 2) AS npv_max
FROM pts GROUP BY project_id
""")
def sensitivity_range(t):
    points = finance.sensitivity(projects(t), "project_id", "cf", ["discount_rate"],
                                 {"discount_rate": (0.08, 0.15)})
    return (finance.sensitivity_table(points, "project_id")
            .withColumn("npv_min", F.round("npv_min", 2)).withColumn("npv_max", F.round("npv_max", 2)))


def requests(t):
    """One model request per customer with orders; richer customers bring their own rate."""
    model = F.create_map(*[F.lit(x) for kv in SEGMENT_MODELS.items() for x in kv])[F.col("c_mktsegment")]
    given = F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("discount_rate"), F.lit(0.15))) \
        .otherwise(F.create_map().cast("map<string,double>"))
    customers = t.customer.select(F.col("c_custkey").alias("project_id"), model.alias("model_type"),
                                  given.alias("assumptions"))
    return projects(t).join(customers, "project_id")


MODEL_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_MODELS.items()) + " END"


@query("fin6_assumptions", f"""
SELECT c_custkey AS project_id, {MODEL_CASE} AS model_type,
  CASE WHEN c_acctbal > 5000 THEN 0.15 WHEN c_mktsegment = 'FURNITURE' THEN 0.12
       WHEN c_mktsegment = 'AUTOMOBILE' THEN 0.10 END AS discount_rate,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 0.03 END AS terminal_growth,
  CAST(CASE c_mktsegment WHEN 'FURNITURE' THEN 8 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 1 ELSE 0 END
    + CASE WHEN c_acctbal > 5000 AND c_mktsegment NOT IN ('FURNITURE', 'AUTOMOBILE') THEN 1 ELSE 0 END AS INTEGER) AS n_used
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def assumptions(t):
    used = finance.with_assumptions(requests(t))
    pick = F.col("assumptions_used")
    return used.select("project_id", "model_type",
                       F.try_element_at(pick, F.lit("discount_rate")).alias("discount_rate"),
                       F.try_element_at(pick, F.lit("terminal_growth")).alias("terminal_growth"),
                       F.size(pick).alias("n_used"))


MODELS_SQL = f"""
WITH RECURSIVE {FLOWS_SQL}, {IRR_SQL},
req AS (
  SELECT c_custkey AS project_id, {MODEL_CASE} AS model_type, c_acctbal > 5000 AS own,
    CASE WHEN c_acctbal > 5000 THEN 0.15 WHEN c_mktsegment = 'FURNITURE' THEN 0.12 ELSE 0.10 END AS rate FROM customer),
val AS (
  SELECT c.project_id, any_value(r.model_type) AS model_type, any_value(r.rate) AS rate,
    SUM(cf / pow(1 + r.rate, i)) AS npv, SUM(cf / pow(1 + r.rate, i + 1)) AS pv_fcf, COUNT(*) AS n, arg_max(cf, i) AS last_cf,
    SUM(cf / pow(1.08, i)) AS s0, SUM(cf / pow(1.0975, i)) AS s1, SUM(cf / pow(1.115, i)) AS s2,
    SUM(cf / pow(1.1325, i)) AS s3, SUM(cf / pow(1.15, i)) AS s4
  FROM cfl c JOIN req r USING (project_id) GROUP BY c.project_id),
run AS (SELECT project_id, i, cf, SUM(cf) OVER (PARTITION BY project_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM cfl),
hit AS (SELECT project_id, arg_min(CASE WHEN i = 0 THEN 0.0 ELSE i - 1 + abs(cum - cf) / abs(cf) END, i) AS payback
        FROM run WHERE cum >= 0 GROUP BY project_id),
res AS (
  SELECT v.project_id, model_type, rate,
    CASE WHEN model_type = 'irr' THEN q.irr END AS irr,
    CASE WHEN model_type = 'payback' THEN h.payback END AS payback_period,
    CASE WHEN model_type = 'dcf' THEN pv_fcf + last_cf * 1.03 / (rate - 0.03) / pow(1 + rate, n) END AS dcf_value,
    CASE WHEN model_type IN ('npv', 'sensitivity') THEN v.npv END AS npv,
    least(s0, s1, s2, s3, s4) AS smin, greatest(s0, s1, s2, s3, s4) AS smax
  FROM val v LEFT JOIN irrs q USING (project_id) LEFT JOIN hit h USING (project_id))
"""


@query("fin7_model_dispatch", MODELS_SQL + """
SELECT project_id, model_type, ROUND(irr, 6) AS irr, ROUND(payback_period, 6) AS payback_period,
  ROUND(dcf_value, 2) AS dcf_value, ROUND(CASE WHEN model_type = 'dcf' THEN dcf_value ELSE npv END, 2) AS npv,
  irr IS NOT NULL AS npv_at_irr
FROM res
""")
def dispatch(t):
    ran = finance.run_models(finance.with_assumptions(requests(t)))
    at_irr = F.col("irr").isNotNull() & (F.abs("npv") < 1e-6 * F.array_max(F.transform("cf", lambda x: F.abs(x))))
    return ran.select("project_id", "model_type", F.round("irr", 6).alias("irr"),
                      F.round("payback_period", 6).alias("payback_period"),
                      F.round("dcf_value", 2).alias("dcf_value"),
                      F.when(F.col("model_type") != "irr", F.round("npv", 2)).alias("npv"),
                      at_irr.alias("npv_at_irr"))


@query("fin8_verdict_text", MODELS_SQL + r"""
SELECT project_id, upper(model_type) || E' Analysis Complete.\n' || CASE
  WHEN model_type = 'npv' THEN E'\nNPV: $' || format('{:,.2f}', npv) || ' at ' || format('{:.1f}', rate * 100) || E'% discount rate.\n'
    || CASE WHEN npv > 0 THEN 'Positive NPV indicates value creation.' ELSE 'Negative NPV indicates value destruction.' END
  WHEN model_type = 'irr' AND irr IS NOT NULL THEN E'\nIRR: ' || format('{:.2f}', irr * 100) || E'%.\nProject '
    || CASE WHEN irr > rate THEN 'exceeds' ELSE 'below' END || ' hurdle rate of ' || format('{:.1f}', rate * 100) || '%.'
  WHEN model_type = 'dcf' THEN E'\nDCF Enterprise Value: $' || format('{:,.2f}', dcf_value) || E'.\nTerminal growth assumption: 3.0%.'
  WHEN model_type = 'payback' AND payback_period IS NOT NULL THEN E'\nPayback Period: ' || format('{:.2f}', payback_period) || ' years.'
  WHEN model_type = 'sensitivity' THEN E'\nSensitivity analysis shows NPV impact of key variables.\ndiscount_rate: NPV range $'
    || format('{:,.0f}', smin) || ' to $' || format('{:,.0f}', smax) || '.'
  ELSE '' END AS explanation
FROM res
""")
def verdicts(t):
    ran = finance.run_models(finance.with_assumptions(requests(t)))
    return finance.explain_models(ran).select("project_id", "explanation")


@query("fin8_request_ranges", f"""
WITH {FLOWS_SQL},
req AS (SELECT c_custkey AS project_id, c_custkey % 3 AS kind, (c_custkey % 7) / 100.0 AS low, (c_custkey % 7) / 100.0 + 0.1 AS high FROM customer),
v AS (SELECT project_id, unnest(CASE kind WHEN 0 THEN ['discount_rate'] WHEN 1 THEN ['tax_rate', 'discount_rate'] ELSE ['unranged'] END) AS variable,
    unnest(CASE kind WHEN 0 THEN [1] WHEN 1 THEN [1, 2] ELSE [1] END) AS place, CASE kind WHEN 0 THEN 0.08 ELSE low END AS low, CASE kind WHEN 0 THEN 0.15 ELSE high END AS high FROM req),
pts AS (SELECT project_id, variable, place, s, SUM(cf / pow(1 + CASE WHEN variable = 'discount_rate' THEN low + s * (high - low) / 4 ELSE 0.1 END, i)) AS npv
  FROM cfl JOIN v USING (project_id) CROSS JOIN range(5) r(s) WHERE variable <> 'unranged' GROUP BY ALL),
per AS (SELECT project_id, place, variable || ': NPV range $' || format('{{:,.0f}}', MIN(npv)) || ' to $' || format('{{:,.0f}}', MAX(npv)) || '.' AS line
  FROM pts GROUP BY project_id, place, variable)
SELECT p.project_id, E'SENSITIVITY Analysis Complete.\n' || coalesce(E'\nSensitivity analysis shows NPV impact of key variables.\n' || text, '') AS explanation
FROM (SELECT DISTINCT project_id FROM cfl) p LEFT JOIN (SELECT project_id, string_agg(line, E'\n' ORDER BY place) AS text FROM per GROUP BY project_id) USING (project_id)
""")
def request_ranges(t):
    """Requests that name their variables and ranges, some of them none and some a variable without a range."""
    key, kind = F.col("project_id"), F.col("project_id") % 3
    low = (key % 7) / 100.0
    ends = F.struct(low.alias("low"), (low + 0.1).alias("high"))
    asked = projects(t).select(
        "project_id", "cf", F.lit("sensitivity").alias("model_type"), F.create_map().cast("map<string,double>").alias("assumptions"),
        F.when(kind == 1, F.array(F.lit("tax_rate"), F.lit("discount_rate"))).when(kind == 2, F.array(F.lit("unranged"))).alias("variables"),
        F.when(kind > 0, F.create_map(F.lit("discount_rate"), ends, F.lit("tax_rate"), ends)).alias("ranges"))
    ran = finance.run_models(finance.with_assumptions(asked), variables="variables", ranges="ranges")
    return finance.explain_models(ran).select("project_id", "explanation")


def questions(t):
    """A financial question per part, its figures taken from the part's own columns."""
    price = F.round("p_retailprice", 2).cast("decimal(12,2)").cast("string")
    size = F.col("p_size").cast("string")
    flows = F.concat(F.lit("[-"), price, F.lit(", 300, "), size, F.lit("00.5, 500]"))
    text = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Calculate NPV of cash flows "), flows, F.lit(" at "), size, F.lit("% discount rate")))
            .when(F.col("p_type") == "LARGE", F.concat(F.lit("Build a DCF model with "), size, F.lit("% discount rate and 3.5% terminal growth")))
            .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("What is the IRR of "), flows, F.lit("?")))
            .when(F.col("p_type") == "PROMO", F.concat(F.lit("Payback period for project with cash flows "), flows))
            .when(F.col("p_type") == "SMALL", F.concat(F.lit("Run sensitivity analysis on DCF with "), size, F.lit("% growth")))
            .otherwise(F.concat(F.lit("Show the price of "), F.col("p_name"))))
    return t.part.select("p_partkey", text.alias("question"))


@query("fin9_params_from_text", """
WITH p AS (SELECT p_partkey, p_type, CAST(p_size AS VARCHAR) AS s, CAST(ROUND(p_retailprice, 2) AS DECIMAL(12,2)) AS price, p_size FROM part)
SELECT p_partkey,
  CASE p_type WHEN 'ECONOMY' THEN 'npv' WHEN 'LARGE' THEN 'dcf' WHEN 'MEDIUM' THEN 'irr' WHEN 'PROMO' THEN 'payback'
       WHEN 'SMALL' THEN 'sensitivity' END AS model_type,
  CASE WHEN p_type IN ('ECONOMY', 'MEDIUM', 'PROMO')
       THEN ROUND(-CAST(price AS DOUBLE) + 300 + p_size * 100 + 0.5 + 500, 2) END AS flow_total,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN ROUND(p_size / 100.0, 4) END AS discount_rate,
  CASE WHEN p_type = 'LARGE' THEN 0.035 WHEN p_type = 'SMALL' THEN ROUND(p_size / 100.0, 4) END AS terminal_growth
FROM p
""")
def params(t):
    found = finance.extract_model_params(questions(t))
    total = F.aggregate("cash_flows", F.lit(0.0), lambda a, x: a + x)
    return found.select("p_partkey", "model_type", F.round(total, 2).alias("flow_total"),
                        F.round("discount_rate", 4).alias("discount_rate"),
                        F.round("terminal_growth", 4).alias("terminal_growth"))


FORMAT_SQL = """
WITH v AS (
  SELECT c_custkey AS id, c_acctbal * CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0.01 WHEN 'BUILDING' THEN 1
    WHEN 'FURNITURE' THEN 1000 WHEN 'HOUSEHOLD' THEN 1000000 END AS v FROM customer)
"""


def amounts(t):
    scale = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0.01).when(F.col("c_mktsegment") == "BUILDING", 1.0)
             .when(F.col("c_mktsegment") == "FURNITURE", 1e3).when(F.col("c_mktsegment") == "HOUSEHOLD", 1e6))
    return t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * scale).alias("v"))


@query("fmt1_currency", FORMAT_SQL + """
SELECT id, CASE WHEN v IS NULL THEN 'N/A' WHEN abs(v) >= 1e9 THEN '$' || format('{:.2f}', v / 1e9) || 'B'
  WHEN abs(v) >= 1e6 THEN '$' || format('{:.2f}', v / 1e6) || 'M' WHEN abs(v) >= 1e3 THEN '$' || format('{:.2f}', v / 1e3) || 'K'
  ELSE '$' || format('{:,.2f}', v) END AS text FROM v
""")
def currency(t):
    return amounts(t).select("id", formats.format_currency("v").alias("text"))


@query("fmt2_percent", FORMAT_SQL + """
SELECT id, CASE WHEN v IS NULL THEN 'N/A' ELSE format('{:.2f}', v / 1e4 * 100) || '%' END AS text FROM v
""")
def percents(t):
    return amounts(t).select("id", formats.format_pct(F.col("v") / 1e4).alias("text"))


@query("fmt3_number", FORMAT_SQL + """
SELECT id, CASE WHEN v IS NULL THEN 'N/A' WHEN abs(v) >= 1e6 THEN format('{:.2f}', v / 1e6) || 'M'
  WHEN abs(v) >= 1e3 THEN format('{:.2f}', v / 1e3) || 'K' ELSE format('{:,.2f}', v) END AS text FROM v
""")
def numbers(t):
    return amounts(t).select("id", formats.format_number("v").alias("text"))
