"""Text forms of numbers used in reports and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def grouped(value: Column | str, decimals: int = 2) -> Column:
    """``1,234.56``"""
    return F.format_number(_col(value).cast("double"), decimals)


def plain(value: Column | str, decimals: int = 2) -> Column:
    """``1234.56``, rounded the same way as :func:`grouped`."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", _col(value).cast("double"), F.lit(pattern))


def percent(value: Column | str, decimals: int = 2) -> Column:
    return F.concat(plain(_col(value) * 100, decimals), F.lit("%"))


def format_currency(value: Column | str) -> Column:
    v = _col(value).cast("double")
    size = F.abs(v)
    return (F.when(v.isNull(), F.lit("N/A"))
            .when(size >= 1e9, F.concat(F.lit("$"), plain(v / 1e9), F.lit("B")))
            .when(size >= 1e6, F.concat(F.lit("$"), plain(v / 1e6), F.lit("M")))
            .when(size >= 1e3, F.concat(F.lit("$"), plain(v / 1e3), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), grouped(v))))


def format_pct(value: Column | str) -> Column:
    return F.coalesce(percent(value), F.lit("N/A"))


def format_number(value: Column | str) -> Column:
    v = _col(value).cast("double")
    size = F.abs(v)
    return (F.when(v.isNull(), F.lit("N/A"))
            .when(size >= 1e6, F.concat(plain(v / 1e6), F.lit("M")))
            .when(size >= 1e3, F.concat(plain(v / 1e3), F.lit("K")))
            .otherwise(grouped(v)))
