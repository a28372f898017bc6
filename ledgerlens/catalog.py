"""Registry of named queries: a Spark builder and, where SQL can say the
same thing, an equivalent SQL text for a second engine (the oracle).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables in ``sf_dir`` (mapped onto the sales model by
:mod:`ledgerlens.sources.fixtures`). Oracle texts read the same tables as
pre-registered views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # Importing the query modules fills the registry.
    from ledgerlens.plans import queries_reports  # noqa: F401
    from ledgerlens.plans import queries_classes  # noqa: F401
    from ledgerlens.plans import queries_prices  # noqa: F401
    from ledgerlens.plans import queries_calendar  # noqa: F401
    from ledgerlens.plans import queries_basic  # noqa: F401
