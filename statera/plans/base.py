"""What every plan module registers its queries with."""

from __future__ import annotations

from statera.plans.views import with_views


def book():
    """(queries, sql, query): two dicts and the decorator that fills them. sql is DuckDB SQL for the same rows, over the views named."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(name: str, sql: str | None = None, *views: str):
        def put(f):
            queries[name] = f
            if sql is not None:
                sqls[name] = with_views(sql, *views) if views else sql
            return f

        return put

    return queries, sqls, query
