"""Registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("metric_queries", "frame_queries", "pool_queries", "text_queries", "signal_queries", "line_queries", "stream_queries", "source_queries")


def all_queries():
    """(queries, SQL counterparts) of every query module."""
    from segflow.plans import registry

    for name in _MODULES:
        importlib.import_module(f"segflow.plans.{name}")
    return registry.QUERIES, registry.ORACLES
