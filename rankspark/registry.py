"""Named queries: each pairs a Spark callable with its DuckDB oracle SQL.

Every callable takes ``(spark, sf_dir)``, reads the driver's tables through the
fixture views, and returns a DataFrame; the oracle computes the same result
from the same tables in DuckDB. Column names match one to one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rankspark.sources.fixtures import with_views


@dataclass(frozen=True)
class NamedQuery:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None  # DuckDB SQL over the driver's views, or None (rows-only check)
    survey_id: str
    writes: bool = False  # a write job (files written, then read back), not a report query


REGISTRY: dict[str, NamedQuery] = {}


def register(name: str, survey_id: str, oracle_body: str | None = None, writes: bool = False):
    """Decorator: register ``fn(spark, sf_dir)`` with the body of its oracle.

    The oracle body may refer to ``daily`` and ``hourly`` (the fixture CTEs).
    """

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise KeyError(f"duplicate query name {name}")
        oracle = with_views(oracle_body) if oracle_body is not None else None
        REGISTRY[name] = NamedQuery(name, fn, oracle, survey_id, writes)
        return fn

    return deco


def load_all() -> dict[str, NamedQuery]:
    # Importing the modules fills REGISTRY.
    import rankspark.queries  # noqa: F401

    return REGISTRY
