"""The registry that plan modules add their queries to."""

from __future__ import annotations

from collections.abc import Callable

from haulmark.sources.domain import DOMAIN_SQL

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(spark, sf_dir) with its oracle; sql goes after the domain tables' common table expressions."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = (f, f"WITH {DOMAIN_SQL}\n{sql}" if sql else None)
        return f

    return add
