"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row.

    Inside a lambda a repeated expression is evaluated anew for every element; as the only
    element of an array it becomes a plain lambda variable.
    """
    return F.transform(F.array(value), use)[0]
