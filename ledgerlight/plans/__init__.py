"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

AREAS = ("relational", "finance", "documents", "retrieval", "answers", "evaluation", "telemetry", "forecast", "stores")


def load_all():
    """Every registered query and every checking SQL, by name."""
    for area in AREAS:
        importlib.import_module(f"ledgerlight.plans.{area}")
    from ledgerlight.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
