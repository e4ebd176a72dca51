import pytest

from ledgerlight.operators import guard


@pytest.fixture()
def sources(sample):
    return {name: f"{sample}/{name}.parquet" for name in ("orders", "customer")}


@pytest.mark.parametrize("sql, rule", [
    ("", "empty"),
    ("   ", "empty"),
    ("SELECT " + "1 + " * 13_000 + "1", "length"),
    ("INSERT INTO orders SELECT * FROM orders", "read_only"),
    ("UPDATE orders SET o_totalprice = 0", "read_only"),
    ("DELETE FROM orders", "read_only"),
    ("DROP TABLE orders", "read_only"),
    ("CREATE TABLE x AS SELECT 1", "read_only"),
    ("ALTER TABLE orders ADD COLUMN x INT", "read_only"),
    ("TRUNCATE TABLE orders", "read_only"),
    ("SET spark.sql.ansi.enabled = false", "read_only"),
    ("SHOW TABLES", "read_only"),
    ("EXPLAIN SELECT 1", "read_only"),
    ("SELECT 1; SELECT 2", "statements"),
    ("SELEC o_orderkey FROM orders", "parse"),
    ("SELECT * FROM part", "table"),
    ("WITH part AS (SELECT * FROM part) SELECT * FROM part", "table"),
    ("SELECT (SELECT count(*) FROM part) AS n FROM orders", "table"),
    ("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM part)", "table"),
    ("SELECT * FROM global_temp.hidden", "table"),
    ("SELECT * FROM saved_hidden", "table"),
    ("SELECT * FROM default.saved_hidden", "table"),
    ("SELECT * FROM spark_catalog.default.saved_hidden", "table"),
    ("SELECT * FROM default.orders", "table"),
    ("WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "table"),
    ("SELECT * FROM (WITH c AS (SELECT 1 AS x) SELECT * FROM c) JOIN c", "table"),
    ("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT x FROM saved_hidden)", "table"),
    ("SELECT pg_sleep(10)", "function"),
    ("SELECT lo_import('/etc/passwd')", "function"),
    ("SELECT * FROM dblink('x')", "function"),
    ("SELECT reflect('java.lang.System', 'exit', 0)", "function"),
    ("SELECT upper(java_method('java.lang.System', 'getenv', 'HOME'))", "function"),
    ("WITH c AS (SELECT reflect('java.lang.Math', 'abs', 1) AS x) SELECT * FROM c", "function"),
    ("SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', 1)", "function"),
    ("SELECT no_such_column FROM orders", "analysis"),
])
def test_refused(spark, sources, sql, rule):
    spark.range(3).createOrReplaceGlobalTempView("hidden")
    spark.sql("CREATE TABLE IF NOT EXISTS saved_hidden USING parquet AS SELECT 1 AS x")
    with pytest.raises(guard.GuardError) as refused:
        guard.guarded_query(spark, sql, sources)
    assert refused.value.rule == rule


def test_files_by_path_are_refused(spark, sources, sample):
    with pytest.raises(guard.GuardError):
        guard.guarded_query(spark, f"SELECT * FROM parquet.`{sample}/part.parquet`", sources)


@pytest.mark.parametrize("sql", [
    "SELECT o_orderkey FROM orders LIMIT 5",
    "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100) SELECT count(*) AS n FROM big",
    "SELECT c_name, o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "WITH orders AS (SELECT 7 AS x) SELECT x FROM orders",
    "WITH a AS (SELECT * FROM orders), b AS (SELECT * FROM a) SELECT * FROM b WHERE EXISTS (SELECT 1 FROM a)",
    "SELECT * FROM ORDERS o WHERE o_custkey IN (WITH c AS (SELECT c_custkey FROM customer) SELECT c_custkey FROM c)",
    "SELECT o_orderkey FROM orders UNION SELECT c_custkey FROM customer",
    "SELECT 'drop table orders; reflect(' AS text FROM orders",
    "SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders ORDER BY 1",
    "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1;",
    "```sql\nSELECT 1 AS x\n```",
])
def test_allowed(spark, sources, sql):
    assert guard.guarded_query(spark, sql, sources).count() >= 1


def test_guarded_session_leaves_the_callers_views_alone(spark, sources):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(guard.GuardError):
        guard.guarded_query(spark, "SELECT * FROM secret", sources)
    assert spark.table("secret").count() == 3


@pytest.mark.parametrize("text, want", [
    ("```sql\nSELECT 1\n```", "SELECT 1"), ("```\nSELECT 1\n```", "SELECT 1"), ("SELECT 1", "SELECT 1"),
    ("  ```SQL SELECT 1```  ", "SELECT 1"),
])
def test_fences(one, text, want):
    assert one(guard.strip_fences("t"), t=text) == want
    assert guard.strip_fences_text(text) == want


def test_identifiers(one):
    for name, ok in (("orders", True), ("_x1", True), ("1x", False), ("a b", False), ("a;drop", False), ("", False)):
        assert one(guard.check_identifier("t"), t=name) is ok


def test_columns_must_exist(spark):
    tables = {"t": spark.createDataFrame([(1, 2)], ["a", "b"])}
    guard.check_columns(tables, "t", ["a", "b"])
    for table, column in (("u", "a"), ("t", "c"), ("t", "a b")):
        with pytest.raises(guard.GuardError):
            guard.check_columns(tables, table, [column])


def test_cost_gate(spark, sample):
    df = spark.read.parquet(f"{sample}/lineitem.parquet")
    assert guard.estimate_cost(df, 1 << 40).status == "success"
    assert guard.estimate_cost(df, 10).status == "blocked"
    assert 0 < len(guard.estimate_cost(df.groupBy("l_returnflag").count(), 10).plan_summary.splitlines()) <= 10
    with pytest.raises(guard.GuardError):
        guard.cost_gate(df, 10)


def test_a_join_by_keys_is_not_taken_for_every_pair_of_rows(spark, tmp_path):
    sources = {}
    for name, key, n in (("orders", "o_custkey", 60_000), ("customer", "c_custkey", 6_000)):
        sources[name] = str(tmp_path / name)
        spark.range(n).selectExpr(f"id AS {key}", "md5(cast(id AS string)) AS word").write.parquet(sources[name])

    def cost(sql):
        return guard.estimate_cost(guard.guarded_query(spark, sql, sources, max_bytes=None), 1 << 40).size_bytes

    read = cost("SELECT * FROM orders") + cost("SELECT * FROM customer")
    by_key = cost("SELECT o.word, c.word AS other FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.word <> c.word")
    assert by_key <= 4 * read
    assert cost("SELECT o.word, max(c.word) AS m FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.word") <= 4 * read
    for pairs in ("SELECT o.*, c.* FROM orders o, customer c", "SELECT o.*, c.* FROM orders o JOIN customer c ON o.word < c.word"):
        assert cost(pairs) > 1000 * read
    assert guard.run_guarded(spark, "SELECT c_custkey FROM customer", sources, max_rows=6_000).row_count == 6_000


def test_row_cap_reports_the_uncut_count(spark):
    rows, count = guard.capped(spark.range(2500), ["id"], 1000)
    assert rows.count() == 1000 and count.first()["row_count"] == 2500


def test_time_limit(spark):
    slow = spark.range(0, 1_000_000_000, numPartitions=64).selectExpr("sum(pow(sin(id), 2)) AS s")
    with pytest.raises(guard.GuardError) as stopped:
        guard.within_time(spark, slow.collect, 1.0)
    assert stopped.value.rule == "timeout"
    assert guard.within_time(spark, spark.range(3).count, 30) == 3
    with pytest.raises(ZeroDivisionError):
        guard.within_time(spark, lambda: 1 // 0, 30)


def test_one_path_gates_times_and_caps(spark, sources):
    result = guard.run_guarded(spark, "SELECT o_orderkey FROM orders", sources, max_rows=10)
    assert (result.rows.count(), result.row_count, result.truncated) == (10, 1500, True)
    whole = guard.run_guarded(spark, "SELECT o_orderkey FROM orders WHERE o_orderkey < 0", sources)
    assert (whole.rows.count(), whole.row_count, whole.truncated) == (0, 0, False)
    for limits, rule in (({"max_bytes": 1}, "cost"), ({"seconds": 0.0}, "timeout")):
        slow = "SELECT sum(a.o_totalprice * sin(b.o_totalprice) * cos(c.c_acctbal)) AS s FROM orders a, orders b, customer c"
        with pytest.raises(guard.GuardError) as stopped:
            guard.run_guarded(spark, slow, sources, **limits)
        assert stopped.value.rule == rule
