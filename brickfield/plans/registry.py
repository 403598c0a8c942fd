"""Collects the volume engine's queries and their SQL. Importing a module of queries registers them."""

from __future__ import annotations

from . import file_queries, fit_queries, geometry_queries, point_queries, transform_queries, volume_queries

MODULES = (volume_queries, geometry_queries, transform_queries, file_queries, point_queries, fit_queries)


def queries() -> dict:
    return dict(volume_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(volume_queries.SQL)
