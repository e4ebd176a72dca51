"""Running a user's SQL text safely: fences, rules, row cap and cost gate."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import TypeVar

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage

MAX_ROWS = 1000
MAX_QUERY_CHARS = 50_000
#: Bytes a query may read or make, by the optimiser's estimate.
MAX_QUERY_BYTES = 1 << 40
TIMEOUT_SECONDS = 30
Result = TypeVar("Result")

# Functions a question may not call. The first group are database file and
# sleep functions, the second reach arbitrary JVM code from Spark SQL.
BLOCKED_FUNCTIONS = (
    "pg_sleep", "lo_import", "lo_export", "dblink", "copy",
    "pg_read_file", "pg_write_file", "pg_ls_dir", "pg_stat_file",
    "reflect", "java_method", "try_reflect",
)

# Logical nodes of a read-only query. Anything else is a command.
QUERY_NODES = (
    "Aggregate", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "OneRowRelation", "Offset", "Pivot", "Project", "Sample", "Sort",
    "SubqueryAlias", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedOrderBy",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction",
    "UnresolvedWith", "Union", "Unpivot", "WithWindowDefinition", "Generate", "Window",
)

IDENTIFIER_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]*$"

_COPIED_CONF = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")


class GuardError(ValueError):
    """A query was refused; ``rule`` names the rule it broke."""

    def __init__(self, rule: str, message: str):
        super().__init__(message)
        self.rule = rule


@dataclass(frozen=True)
class CostEstimate:
    size_bytes: int | None
    status: str
    plan_summary: str
    error: str | None = None


def strip_fences(sql: Column | str) -> Column:
    """SQL text without Markdown code fences."""
    c = F.col(sql) if isinstance(sql, str) else sql
    space = r"^\s+|\s+$"
    c = F.regexp_replace(c, space, "")
    c = F.regexp_replace(c, r"(?i)^```sql\s*", "")
    c = F.regexp_replace(c, r"^```\s*", "")
    c = F.regexp_replace(c, r"\s*```$", "")
    return F.regexp_replace(c, space, "")


def strip_fences_text(sql: str) -> str:
    body = re.sub(r"^```(?:sql)?\s*", "", sql.strip(), flags=re.IGNORECASE)
    return re.sub(r"\s*```$", "", body).strip()


def check_identifier(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c.rlike(IDENTIFIER_PATTERN), F.lit(False))


def check_columns(tables: Mapping[str, DataFrame], table: str, columns: Iterable[str]) -> None:
    """Refuse bad identifiers and names the registered tables do not have."""
    for name in (table, *columns):
        if not re.fullmatch(IDENTIFIER_PATTERN[1:-1], name):
            raise GuardError("identifier", f"invalid identifier: {name}")
    if table not in tables:
        raise GuardError("table", f"table '{table}' not found")
    for name in columns:
        if name not in tables[table].columns:
            raise GuardError("column", f"column '{name}' not found in table '{table}'")


def _nodes(plan):
    """Every logical node of a parsed plan, those inside subqueries and CTEs included."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            stack.extend(group.apply(i) for i in range(group.size()) if hasattr(group.apply(i), "children"))


def _each(group) -> Iterable:
    return (group.apply(i) for i in range(group.size()))


def check_tables(plan, allowed: Iterable[str]) -> None:
    """Refuse a parsed plan that names a table other than an allowed one or a CTE in scope there.

    Qualified names reach other catalogs, global views and saved tables, so none is allowed.
    """
    names = frozenset(name.lower() for name in allowed)

    def check(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = [str(part) for part in _each(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in names | scope:
                raise GuardError("table", f"table not in the allowed list: {'.'.join(parts)}")
        inner = [n for n in _each(node.subqueries()) if hasattr(n, "children")]
        if kind == "UnresolvedWith":
            for relation in _each(node.cteRelations()):
                name, own = str(relation.productElement(0)).lower(), scope
                if node.allowRecursion():
                    own = scope | {name}
                check(relation.productElement(1), own)
                scope = scope | {name}
        else:
            inner += [n for n in _each(node.innerChildren()) if hasattr(n, "children")]
        for child in (*_each(node.children()), *inner):
            check(child, scope)

    check(plan, frozenset())


def _called(node):
    """Lower-case names of the functions a logical node calls."""
    if node.getClass().getSimpleName() == "UnresolvedTableValuedFunction":
        yield str(node.name().last()).lower()
    expressions = node.expressions()
    stack = [expressions.apply(i) for i in range(expressions.size())]
    while stack:
        expr = stack.pop()
        kind = expr.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            yield str(expr.nameParts().last()).lower()
        elif kind == "ExpressionWithUnresolvedIdentifier":
            raise GuardError("function", "computed function and column names are not allowed")
        children = expr.children()
        stack.extend(children.apply(i) for i in range(children.size()))


def validate_sql(spark: SparkSession, sql: str, max_chars: int = MAX_QUERY_CHARS,
                 blocked: Iterable[str] = BLOCKED_FUNCTIONS):
    """Parse without running and refuse whatever is not one read-only query."""
    if not sql or not sql.strip():
        raise GuardError("empty", "empty SQL query")
    if len(sql) > max_chars:
        raise GuardError("length", f"query exceeds {max_chars} characters")
    body = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except ParseException as error:
        if ";" in body and re.search(r"near '\w+'", str(error)):
            raise GuardError("statements", "more than one statement or a syntax error") from error
        raise GuardError("parse", f"SQL parsing failed: {error}") from error
    blocked = {name.lower() for name in blocked}
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            raise GuardError("read_only", f"only SELECT and WITH queries are allowed, found {kind}")
        for name in _called(node):
            if name in blocked:
                raise GuardError("function", f"function not allowed: {name}")
    return plan


def isolated_session(spark: SparkSession, sources: Mapping[str, str]) -> SparkSession:
    """A session whose only temporary views are the allowed Parquet sources; files cannot be read by path.

    The second line of defence: the catalog behind it is shared, so :func:`check_tables` goes first.
    """
    session = spark.newSession()
    for key in _COPIED_CONF:
        value = spark.conf.get(key, None)
        if value is not None:
            session.conf.set(key, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, path in sources.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    return session


def guarded_query(spark: SparkSession, sql: str, sources: Mapping[str, str],
                  max_bytes: int | None = MAX_QUERY_BYTES, blocked: Iterable[str] = BLOCKED_FUNCTIONS) -> DataFrame:
    """The query's rows if it passes every rule and the cost gate, else ``GuardError``. Nothing runs yet.

    ``sources`` maps the allowed table names to Parquet paths.
    """
    body = strip_fences_text(sql)
    check_tables(validate_sql(spark, body, blocked=blocked), sources)
    session = isolated_session(spark, sources)
    try:
        df = session.sql(body.rstrip(";"))
    except AnalysisException as error:
        if error.getCondition() and "TABLE_OR_VIEW_NOT_FOUND" in error.getCondition():
            raise GuardError("table", f"table not in the allowed list: {error}") from error
        raise GuardError("analysis", f"SQL validation failed: {error}") from error
    return df if max_bytes is None else cost_gate(df, max_bytes)


@dataclass(frozen=True)
class GuardedResult:
    """At most ``max_rows`` rows of a query, and how many it has."""

    rows: DataFrame
    row_count: int
    truncated: bool


def run_guarded(spark: SparkSession, sql: str, sources: Mapping[str, str], max_bytes: int = MAX_QUERY_BYTES,
                seconds: float = TIMEOUT_SECONDS, max_rows: int = MAX_ROWS) -> GuardedResult:
    """The one way to run a user's query: rules, cost gate, time limit, row cap, in this order.

    Both the cut rows and the uncut count are worked out within the time limit; only rows that fill the cap are counted
    by a second run.
    """
    df = guarded_query(spark, sql, sources, max_bytes)

    def run() -> GuardedResult:
        cut = cut_lineage(df.limit(max_rows), into=spark)
        held = cut.count()
        count = held if held < max_rows else df.count()
        return GuardedResult(cut, count, count > max_rows)

    return within_time(spark, run, seconds)


def capped(df: DataFrame, order: list[str | Column], max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first ``max_rows`` rows and, apart from them, the uncut row count."""
    return df.orderBy(*order).limit(max_rows), df.agg(F.count(F.lit(1)).alias("row_count"))


def _joins_by_keys(node) -> bool:
    """Whether a logical node is a join with an equality between its sides."""
    if node.getClass().getSimpleName() != "Join" or node.condition().isEmpty():
        return False
    left, right = node.left().outputSet(), node.right().outputSet()
    stack = [node.condition().get()]
    while stack:
        expr = stack.pop()
        kind = expr.getClass().getSimpleName()
        if kind == "And":
            stack += [expr.left(), expr.right()]
        elif kind in ("EqualTo", "EqualNullSafe"):
            a, b = expr.left().references(), expr.right().references()
            if a.size() and b.size() and (a.subsetOf(left) and b.subsetOf(right) or a.subsetOf(right) and b.subsetOf(left)):
                return True
    return False


def _row_bytes(node) -> int:
    return 8 + sum(int(column.dataType().defaultSize()) for column in _each(node.output()))


def _made_bytes(node) -> int:
    """Bytes a logical node makes, by the optimiser's estimate; a join by keys makes as many rows as its larger side.

    Without column statistics the optimiser counts every pair of rows for such a join as for any other, a figure that
    grows with the square of the tables.
    """
    own, inputs = int(str(node.stats().sizeInBytes())), list(_each(node.children()))
    if not inputs:
        return own
    made = [_made_bytes(n) for n in inputs]
    if _joins_by_keys(node):
        return min(own, max(size // _row_bytes(n) + 1 for size, n in zip(made, inputs)) * _row_bytes(node))
    told = [max(int(str(n.stats().sizeInBytes())), 1) for n in inputs]
    if node.getClass().getSimpleName() != "Join":
        made, told = [sum(made)], [max(sum(told), 1)]
    for size, before in zip(made, told):
        if size < before:
            own = own * size // before
    return own


def estimate_cost(df: DataFrame, max_bytes: int) -> CostEstimate:
    """Bytes the optimised plan expects to produce and read; never runs the query."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        size = max(_made_bytes(plan), sum(int(str(leaf.stats().sizeInBytes())) for leaf in _each(plan.collectLeaves())))
        lines = [line for line in str(plan.toString()).splitlines() if line.strip()]
    except Exception as error:  # an estimate that fails lets the query run
        return CostEstimate(None, "error", "", f"estimation failed: {error}")
    blocked = size > max_bytes
    return CostEstimate(size, "blocked" if blocked else "success", "\n".join(lines[:10]),
                        "query cost exceeds limit" if blocked else None)


def cost_gate(df: DataFrame, max_bytes: int) -> DataFrame:
    estimate = estimate_cost(df, max_bytes)
    if estimate.status == "blocked":
        raise GuardError("cost", f"query cost {estimate.size_bytes} exceeds limit {max_bytes}")
    return df


def within_time(spark: SparkSession, action: Callable[[], Result], seconds: float = TIMEOUT_SECONDS) -> Result:
    """Runs an action and cancels its Spark jobs when the time is up."""
    sc, tag = spark.sparkContext, f"timeout-{uuid.uuid4().hex}"
    done, expired = threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        # An action may start jobs one after the other, so cancelling goes on until it ends.
        while not done.wait(wait):
            expired.set()
            sc.cancelJobsWithTag(tag)
            wait = 0.2

    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return action()
    except Exception as error:
        if expired.is_set():
            raise GuardError("timeout", f"query timed out after {seconds} s") from error
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)
