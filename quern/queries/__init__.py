"""Queries on the driver's tables, by inventory id, each with DuckDB SQL where SQL can express it."""
