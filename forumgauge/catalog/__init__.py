"""Registered queries: one per operator, each on whole tables, with equivalent SQL.

A query is a function from :class:`~forumgauge.catalog.tables.Tables` to a DataFrame.
Its SQL runs on the raw tables in another engine and must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .tables import Tables, with_ctes

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` names the stand-in tables its SQL refers to."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_ctes(ctes.split(), sql.strip())
        return function

    return register


def load() -> None:
    from . import aggregates, analyses, columns, evaluation, io, joins, reshape, scoring, text, topics, topk, windows  # noqa: F401
