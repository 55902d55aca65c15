"""Registered queries and, where SQL can say the same, their DuckDB check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def load() -> None:
    from harbinger.plans.catalog import (  # noqa: F401
        attributions,
        evaluation,
        features,
        forward,
        geometry,
        ingest,
        social,
        texts,
        topics,
        trajectory,
    )
