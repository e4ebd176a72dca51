"""All queries of this subpackage, one module each."""

from __future__ import annotations

from ledgerlight.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13  # noqa: F401
from ledgerlight.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
