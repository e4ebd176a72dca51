"""Audit log, query history and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and severities an audit event may have.
EVENT_TYPES = (
    "login_success", "login_failed", "logout", "token_refresh", "token_revoked", "password_changed",
    "permission_denied", "role_changed", "query_executed", "data_source_accessed", "document_uploaded",
    "document_downloaded", "financial_model_created", "forecast_generated", "report_scheduled",
    "report_executed", "user_created", "user_deleted", "organization_created", "organization_deleted",
    "data_source_created", "data_source_deleted", "rate_limit_exceeded", "suspicious_activity",
)
SEVERITIES = ("info", "warning", "error", "critical")


def audit_query(df: DataFrame, user_id: object = None, organization_id: object = None, event_type: str | None = None,
                severity: str | None = None, start: str | None = None, end: str | None = None,
                newest_first: bool = True, limit: int | None = None, tie: str = "event_id") -> DataFrame:
    """Events that meet every given condition; both ends of the time range count."""
    wanted = {"user_id": user_id, "organization_id": organization_id, "event_type": event_type, "severity": severity}
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    kind = df.schema["timestamp"].dataType
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast(kind))
    order = [F.desc("timestamp"), F.desc(tie)] if newest_first else [F.asc("timestamp"), F.asc(tie)]
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def history(df: DataFrame, user_id: object, limit: int = 20, offset: int = 0, user: str = "user_id",
            created: str = "created_at", tie: str = "id") -> DataFrame:
    """One page of a user's questions, newest first."""
    return (df.where(F.col(user) == F.lit(user_id)).orderBy(F.desc(created), F.desc(tie))
            .offset(offset).limit(limit))


def visible_rows(df: DataFrame, viewer: object, is_admin: bool, owner: str = "created_by") -> DataFrame:
    """Rows the viewer created; every row for an admin."""
    return df if is_admin else df.where(F.col(owner) == F.lit(viewer))


def visible_counts(df: DataFrame, users: DataFrame, owner: str = "created_by", user: str = "user_id",
                   is_admin: str = "is_admin") -> DataFrame:
    """How many rows each user may see.

    Rows are counted per owner before the join, so neither a busy owner nor an admin, who
    sees all, is ever paired with the rows themselves.
    """
    per_owner = df.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)))
    return (users.join(per_owner, F.col(user) == F.col(owner), "left")
            .select(user, is_admin, F.when(F.col(is_admin), total.scalar()).otherwise(F.coalesce("_n", F.lit(0))).alias("visible")))


def executions(runs: DataFrame, schedules: DataFrame, schedule_id: object = None, owner_id: object = None,
               limit: int = 50) -> DataFrame:
    """The newest runs with their schedule, for one schedule or owner if given."""
    if schedule_id is not None:
        runs = runs.where(F.col("schedule_id") == F.lit(schedule_id))
    if owner_id is not None:
        schedules = schedules.where(F.col("created_by") == F.lit(owner_id))
    return runs.join(schedules, "schedule_id").orderBy(F.desc("started_at"), F.desc("execution_id")).limit(limit)


def client_key(user_id: str = "user_id", forwarded: str = "forwarded_for", host: str = "host") -> Column:
    """``user:<id>``, else the first forwarded address, else the host, else unknown, as ``ip:<address>``."""
    first = F.trim(F.split_part(F.col(forwarded), F.lit(","), F.lit(1)))
    address = F.when(F.coalesce(F.col(forwarded), F.lit("")) != "", first).otherwise(F.coalesce(F.col(host), F.lit("unknown")))
    return F.coalesce(F.concat(F.lit("user:"), F.col(user_id).cast("string")), F.concat(F.lit("ip:"), address))
