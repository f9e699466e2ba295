"""Every registered query of the library, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name; ctes go before its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


from . import geo_queries, state_queries, stream_queries, text_queries  # noqa: E402,F401  each registers its own
