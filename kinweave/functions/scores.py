"""Similarities as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(up: Column, down: Column) -> Column:
    return F.when(down > 0, up / down).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either is empty or null."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set."""
    return _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def contained_left(a: Column, b: Column) -> Column:
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def contained_right(a: Column, b: Column) -> Column:
    return contained_left(b, a)


#: Relational similarities by their configured name.
RELATIONAL: dict[str, Callable[[Column, Column], Column]] = {"jaccard_coefficient": jaccard}


#: The same over sets of contexts, for the ordered merge.
RELATIONAL_SETS: dict[str, Callable[[frozenset, frozenset], float]] = {"jaccard_coefficient": lambda a, b: len(a & b) / len(a | b) if a and b else 0.0}


def relational(name: str) -> Callable[[Column, Column], Column]:
    if name not in RELATIONAL:
        raise ValueError(f"unknown relational similarity: {name}; known: {', '.join(RELATIONAL)}")
    return RELATIONAL[name]


def match_probability(logit0: Column, logit1: Column) -> Column:
    """Softmax probability of class 1; no overflow."""
    return 1.0 / (1.0 + F.exp(logit0 - logit1))


def fused(attribute: Column, relation: Column, alpha: float) -> Column:
    """(1 - alpha) * attribute + alpha * relation."""
    return (1.0 - alpha) * attribute + alpha * relation


#: Levels of likeness by what they are under; beyond the last, ``high``.
LEVELS = (("low", 0.3), ("medium", 0.6))


def bucket(x: Column) -> Column:
    """zero, low (under 0.3), medium (under 0.6) or high."""
    out = F.when(x == 0, "zero")
    for name, end in LEVELS:
        out = out.when(x < end, name)
    return out.otherwise("high")


def level_of(x: float) -> str:
    """The same of a number."""
    return "zero" if x == 0 else next((name for name, end in LEVELS if x < end), "high")


def pairwise_summary(x: Column) -> Column:
    return F.concat(F.lit("jac="), bucket(x))


def first_distinct(values: Column, k: int = 5) -> Column:
    """The first k distinct elements in order; one at least."""
    return F.slice(F.array_distinct(values), 1, max(1, k))
