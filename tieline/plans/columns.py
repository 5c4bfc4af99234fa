"""Small output helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name)


def stamp(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def listed(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c, "|").alias(name)
