"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; without ``sql`` only its rows are checked."""

    def keep(build: Build) -> Build:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return keep


def builders() -> dict[str, Build]:
    _load()
    return dict(_BUILDERS)


def sql_texts() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from murmurline.plans import queries
    queries.load_all()
