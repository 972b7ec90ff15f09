"""All queries of the relational part, by inventory id, and their DuckDB equivalents."""

from importlib import import_module

from quern.plans.registry import ORACLES, QUERIES

FAMILIES = ["bipartite", "aggregates", "joins", "orders", "sets", "scalars", "statistics", "graphs", "sources", "nulls", "formats", "versions"]

for family in FAMILIES:
    import_module(f"quern.queries.{family}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
