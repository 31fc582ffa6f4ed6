"""Every registered query and its SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, with SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from granary.plans import change_queries, content_queries, date_queries, intent_queries, inventory_queries, relation_queries, review_queries, rule_queries, search_queries, tree_queries  # noqa: E402, F401
