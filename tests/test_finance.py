import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import formats
from ledgerlight.operators import finance

FLOWS = [-100000.0, 30000.0, 40000.0, 50000.0]


@pytest.fixture()
def on(spark):
    def run(column, flows):
        df = spark.createDataFrame([(flows,)], "cf array<double>")
        return df.select(column.alias("v")).first()["v"]

    return run


def test_npv(on):
    assert on(finance.npv("cf", 0.10), FLOWS) == pytest.approx(-2103.6814425244447)
    assert on(finance.npv("cf", 0.10), []) == 0.0


@pytest.mark.parametrize("flows, want", [
    (FLOWS, 0.0889633947),
    ([-100.0, 110.0], 0.10),
    ([-100.0, 0.0, 121.0], 0.10),
    ([-1.0, 21.0], 20.0),
    ([100.0, -110.0], 0.10),
    ([-100.0, 50.0], -0.5),
    ([100.0, 100.0], None),
    ([-5.0], None),
    ([0.0, 0.0], None),
    ([], None),
])
def test_irr(on, flows, want):
    got = on(finance.irr("cf"), flows)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_irr_takes_the_root_nearest_zero(on):
    # Roots at 10 % and 200 %: (1 - 1.1 v)(1 - 3 v).
    assert on(finance.irr("cf"), [-100.0, 410.0, -330.0]) == pytest.approx(0.10, abs=1e-9)


def test_irr_makes_npv_vanish(spark):
    rng = np.random.default_rng(0)
    rows = [([float(-rng.uniform(100, 900)), *map(float, rng.uniform(10, 400, rng.integers(1, 9)))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "cf array<double>").withColumn("irr", finance.irr("cf"))
    gap = F.abs(finance.npv("cf", F.col("irr"))) / F.array_max(F.transform("cf", lambda x: F.abs(x)))
    assert df.where("irr is not null").count() == 300
    assert df.select(F.max(gap)).first()[0] < 1e-6


@pytest.mark.parametrize("flows, want", [
    (FLOWS, 2.6), ([-100000.0, 10000.0, 10000.0, 10000.0], None), ([5.0, 1.0], 0.0), ([-10.0, 10.0], 1.0), ([], None),
    ([-10.0, 20.0, -30.0, 50.0], 0.5),
])
def test_payback(on, flows, want):
    got = on(finance.payback("cf"), flows)
    assert got is None if want is None else got == pytest.approx(want)


def test_dcf(on):
    flows = [100000.0, 110000.0, 121000.0, 133100.0, 146410.0]
    got = on(finance.dcf("cf", 0.12, 0.03), flows)
    pv = sum(f / 1.12 ** (i + 1) for i, f in enumerate(flows))
    terminal = flows[-1] * 1.03 / 0.09
    assert got.pv_fcf == pytest.approx(pv) and got.terminal_value == pytest.approx(terminal)
    assert got.dcf_value == pytest.approx(pv + terminal / 1.12 ** 5)
    assert on(finance.dcf("cf", 0.03, 0.03), flows).dcf_value is None
    assert on(finance.dcf("cf", 0.12, 0.03), []).dcf_value == 0.0


def test_sensitivity(spark):
    df = spark.createDataFrame([(1, [-100.0, 40.0, 50.0, 60.0])], "id int, cf array<double>")
    points = finance.sensitivity(df, "id", "cf", ["discount_rate", "growth", "unranged"],
                                 {"discount_rate": (0.08, 0.15), "growth": (0.0, 1.0)}, steps=4).collect()
    assert len(points) == 8
    rate = sorted((p.step, p.value, p.npv) for p in points if p.variable == "discount_rate")
    assert rate[0][1] == 0.08 and rate[-1][1] == 0.15
    assert all(a[2] > b[2] for a, b in zip(rate, rate[1:]))
    assert len({p.npv for p in points if p.variable == "growth"}) == 1 and all(p.flat for p in points if p.variable == "growth")
    assert finance.sensitivity(df, "id", "cf", ["x"], {}).count() == 0


def test_assumptions_override(spark):
    df = spark.createDataFrame([("dcf", {"discount_rate": 0.2, "own": 1.0}), ("npv", None), ("odd", {"a": 1.0})],
                               "model_type string, assumptions map<string,double>")
    used = {r.model_type: r.assumptions_used for r in finance.with_assumptions(df).collect()}
    assert used["dcf"]["discount_rate"] == 0.2 and used["dcf"]["own"] == 1.0 and used["dcf"]["tax_rate"] == 0.21
    assert used["npv"] == {"discount_rate": 0.10} and used["odd"] == {"a": 1.0}


def test_models_and_text(spark):
    rows = [(m, FLOWS, {}) for m in ("npv", "irr", "payback", "dcf", "sensitivity")]
    df = spark.createDataFrame(rows, "model_type string, cf array<double>, assumptions map<string,double>")
    out = finance.explain_models(finance.run_models(finance.with_assumptions(df)))
    text = {r.model_type: r for r in out.collect()}
    assert text["npv"].explanation.splitlines()[2:] == ["NPV: $-2,103.68 at 10.0% discount rate.", "Negative NPV indicates value destruction."]
    assert "IRR: 8.90%." in text["irr"].explanation and "below hurdle rate of 10.0%" in text["irr"].explanation
    assert abs(text["irr"].npv) < 1e-3
    assert text["payback"].explanation.endswith("Payback Period: 2.60 years.")
    assert text["dcf"].npv == text["dcf"].dcf_value
    assert len(text["sensitivity"].sensitivity_npvs) == 5


def test_ranges_come_from_the_request(spark):
    ranges = {"discount_rate": (0.0, 0.1), "tax_rate": (0.2, 0.3)}
    rows = [("a", ["tax_rate", "discount_rate", "unranged"], ranges), ("b", None, None), ("c", ["x"], ranges), ("d", None, ranges)]
    df = spark.createDataFrame([(k, "sensitivity", FLOWS, {}, v, r) for k, v, r in rows],
                               "k string, model_type string, cf array<double>, assumptions map<string,double>, v array<string>, r map<string,struct<low:double,high:double>>")
    out = finance.explain_models(finance.run_models(finance.with_assumptions(df), variables="v", ranges="r"))
    got = {r.k: r for r in out.collect()}
    table = {x.variable: x.npvs for x in got["a"].sensitivity_table}
    assert list(table) == ["tax_rate", "discount_rate"] and len(set(table["tax_rate"])) == 1
    assert table["discount_rate"][0] == pytest.approx(sum(FLOWS)) and len(table["discount_rate"]) == 5
    assert got["a"].explanation.splitlines()[2:] == [
        "Sensitivity analysis shows NPV impact of key variables.",
        *[f"{v}: NPV range ${min(n):,.0f} to ${max(n):,.0f}." for v, n in table.items()]]
    assert [x.variable for x in got["b"].sensitivity_table] == ["discount_rate"] and got["b"].npv is not None
    assert got["c"].sensitivity_table == [] and got["c"].npv is None and got["d"].sensitivity_table == []


def test_params_from_text(spark):
    rows = [("Calculate NPV of cash flows [-100000, 30000, 40000.5] at 10% discount rate",),
            ("Build a DCF model with 15% discount rate and 3% terminal growth",), ("How are we doing?",)]
    got = finance.extract_model_params(spark.createDataFrame(rows, ["question"])).collect()
    assert (got[0].model_type, got[0].cash_flows, got[0].discount_rate) == ("npv", [-100000.0, 30000.0, 40000.5], 0.10)
    assert (got[1].model_type, got[1].discount_rate, got[1].terminal_growth) == ("dcf", 0.15, 0.03)
    assert got[2].model_type is None and got[2].cash_flows is None


@pytest.mark.parametrize("fn, value, want", [
    (formats.format_currency, 1000.0, "$1.00K"), (formats.format_currency, 1.5e6, "$1.50M"), (formats.format_currency, 2.5e9, "$2.50B"),
    (formats.format_currency, 12.345, "$12.35"), (formats.format_currency, -1500.0, "$-1.50K"), (formats.format_currency, None, "N/A"),
    (formats.format_pct, 0.15, "15.00%"), (formats.format_pct, 0.0123, "1.23%"), (formats.format_pct, 12.0, "1200.00%"), (formats.format_pct, None, "N/A"),
    (formats.format_number, 1000.0, "1.00K"), (formats.format_number, 1.5e6, "1.50M"), (formats.format_number, 999.5, "999.50"), (formats.format_number, None, "N/A"),
])
def test_formats(one, fn, value, want):
    assert one(fn("v0"), schema="v0 double", v0=value) == want


@pytest.mark.parametrize("flows,want", [
    ([-1.0, 0.001], -0.999), ([-100.0, 222.0, -123.2075], 0.105), ([-100.0, 230.0, -132.0], 0.1), ([-1.0, 3e9], 3e9 - 1),
    ([1.0, 2.0], None), ([0.0, 0.0], None), ([-100.0, 50.0, 40.0], None), ([0.0, -100.0, 110.0], 0.1),
])
def test_irr_off_the_grid(spark, flows, want):
    from ledgerlight.operators import finance
    got = spark.createDataFrame([(flows,)], "cf array<double>").select(finance.irr("cf").alias("r")).first()["r"]
    if flows == [-100.0, 50.0, 40.0]:
        assert got == pytest.approx(-0.0698, abs=1e-3)
    else:
        assert (got is None) if want is None else got == pytest.approx(want, rel=1e-6)


def test_irr_of_missing_flows_is_null(spark):
    from ledgerlight.operators import finance
    rows = [([-1.0, None, 2.0],), ([-1.0, float("nan")],), ([-1.0, float("inf")],), (None,), ([],)]
    assert [r["r"] for r in spark.createDataFrame(rows, "cf array<double>").select(finance.irr("cf").alias("r")).collect()] == [None] * 5
