"""Registered queries: each operator over the driver tables, with its SQL."""

from .registry import ORACLE, QUERIES

from . import (  # noqa: F401,E402
    aggregates,
    asof,
    calendar,
    composites,
    extraction,
    history,
    io,
    model,
    rules,
    scalars,
)

__all__ = ["ORACLE", "QUERIES"]
