"""Every operator as a registered query over the given tables, with its SQL oracle."""

from __future__ import annotations

import importlib

MODULES = [
    "reports",
    "input_queries",
    "token_queries",
    "trace_queries",
    "detector_queries",
    "mixing_queries",
    "sweep_queries",
    "stream_queries",
]


def load():
    """(queries, oracle SQL), keyed by query name."""
    from tracefork.catalog.registry import ORACLE, QUERIES

    for name in MODULES:
        importlib.import_module(f"tracefork.catalog.{name}")
    return QUERIES, ORACLE
