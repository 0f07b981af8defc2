"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.bindings import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the bound tables; ``sql`` is the same result in plain SQL."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rnd(column: Column | str, digits: int = 9) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits)


def day_text(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.date_format(column, "yyyy-MM-dd")


def clock_text(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def with_ctes(body: str, *ctes: str) -> str:
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def load() -> None:
    """Import every module that registers queries."""
    from fourclocks.registry import (  # noqa: F401
        aggregates,
        audits,
        contracts,
        functions,
        history,
        joins,
        jobs,
        seats,
        sources,
        streams,
        windows,
    )
