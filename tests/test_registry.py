import __spark_entry__ as entry


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_flagship(spark, sample):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and set(rows[0].asDict()) == {"customer_segment", "avg_order_value"}


def test_relational_plans_push_filters_and_prune_columns(spark, sample):
    plan = entry.queries()["ag1_period_total"](spark, sample)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_no_plan_multiplies_tables(spark, sample):
    for name in ("ret2_knn", "fin5_sensitivity", "ev3_ndcg_at_k", "jn10_near_copies", "ag10_request_metrics_by_operation"):
        plan = entry.queries()[name](spark, sample)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
