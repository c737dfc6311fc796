"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t`` gives the tables of one scale."""
    def register(fn):
        from checks.fixtures import Tables

        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def each(names: list[str], template: str, glue: str = " UNION ALL ") -> str:
    """The template once per column: {c} is the name, {i} its position."""
    return glue.join(template.replace("{c}", c).replace("{i}", str(i)) for i, c in enumerate(names))
