"""Registry of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from pairwell.session import configure
from suite.oracle import oracle
from suite.tables import Tables

Case = Callable[[Tables], DataFrame]

_CASES: dict[str, Case] = {}
_SQL: dict[str, str] = {}
_BODY: dict[str, str] = {}


def body(name: str) -> str:
    """The SQL of a query registered before, for use inside another."""
    return f"({_BODY[name]})"


def case(name: str, sql: str | None = None) -> Callable[[Case], Case]:
    """Register a query; ``sql`` gives the same rows in DuckDB."""
    def register(fn: Case) -> Case:
        if name in _CASES:
            raise ValueError(f"query {name} is registered twice")
        _CASES[name] = fn
        if sql is not None:
            _SQL[name], _BODY[name] = oracle(sql), sql
        return fn

    return register


def _load() -> None:
    for module in ("scalars", "selection", "ingestion", "matching", "extracts", "reporting", "storage"):
        import_module(f"suite.cases_{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {
        name: (lambda spark, sf_dir, fn=fn: fn(Tables(configure(spark), sf_dir)))
        for name, fn in _CASES.items()
    }


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
