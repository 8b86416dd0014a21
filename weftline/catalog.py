"""Every query of the library with its check in DuckDB SQL."""

from __future__ import annotations

from weftline.plans import storage_queries, text_queries


def queries() -> dict:
    return text_queries.QUERIES | storage_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.ORACLES | storage_queries.ORACLES
