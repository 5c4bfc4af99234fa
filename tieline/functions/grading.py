"""Deterministic answer graders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MINUS_SIGNS = "−–—➖"


def fold_minus(text: Column) -> Column:
    """Unicode minus signs and dashes to the ASCII hyphen."""
    return F.translate(F.coalesce(text, F.lit("")), MINUS_SIGNS, "-" * len(MINUS_SIGNS))


def contains_value(answer: Column, value: Column) -> Column:
    return F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.trim(value)))


def near_integer(answer: Column, target: Column, tolerance: Column) -> Column:
    """Any integer of the answer (thousands commas allowed) within the tolerance."""
    found = F.regexp_extract_all(fold_minus(answer), F.lit(r"(-?\d[\d,]*)"), F.lit(1))
    return F.exists(found, lambda m: F.abs(F.replace(m, F.lit(","), F.lit("")).try_cast("double") - target) <= tolerance)


def near_number(answer: Column, target: Column, tolerance: Column) -> Column:
    """Any number within the tolerance; for targets in [0, 1] also any percentage."""
    text = fold_minus(answer)
    plain = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    share = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)\s*%"), F.lit(1))
    near = lambda m, scale: F.abs(m.cast("double") / scale - target) <= tolerance
    return F.exists(plain, lambda m: near(m, 1.0)) | (
        target.between(0.0, 1.0) & F.exists(share, lambda m: near(m, 100.0))
    )


def names_found(answer: Column, names: Column) -> Column:
    """How many names occur in full, or by a last word of four letters or more."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    last = lambda n: F.lower(F.element_at(F.split(F.trim(n), r"\s+"), -1))
    return F.size(
        F.filter(names, lambda n: F.contains(low, F.lower(n)) | ((F.length(last(n)) >= 4) & F.contains(low, last(n))))
    )


def grade(answer: Column, kind: Column, value: Column, tolerance: Column, names: Column, k: Column) -> Column:
    """Pass or fail by the grading clause's kind; NULL where a judge is needed, false for unknown kinds."""
    number = value.try_cast("double")
    return (
        F.when(kind == "contains", contains_value(answer, value))
        .when(kind == "integer", near_integer(answer, number, F.coalesce(tolerance, F.lit(0.0))))
        .when(kind == "numeric", near_number(answer, number, tolerance))
        .when(kind == "name_in_set", names_found(answer, names) >= k)
        .when(kind == "judge", F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
