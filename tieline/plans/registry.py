"""Name → query and name → SQL oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tieline.plans.shapes import SHAPES_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def with_shapes(body: str) -> str:
    """Prefix a SQL body with the shape CTEs it (transitively) names."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in SHAPES_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    ctes = [f"{name} AS {'MATERIALIZED ' * (name == 'mail')}({definition})" for name, definition in SHAPES_SQL.items() if name in needed]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``covers`` lists the inventory ids it shows."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = with_shapes(sql)
        return fn

    return wrap
