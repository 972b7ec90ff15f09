"""A registry of queries and of their DuckDB equivalents."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a callable (spark, sf_dir) -> DataFrame under its name, and ``sql`` as what DuckDB should find."""

    def register(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
