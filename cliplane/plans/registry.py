"""Names every query of the engine and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def keep(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from cliplane.plans import library_queries, parsing_queries, rule_queries, stream_queries, text_queries, timeline_queries, tracker_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
