"""Filter predicates; each answers None when its argument means "no filter"."""

from functools import reduce

from pyspark.sql import Column, functions as F


def equals(column: str, value) -> Column | None:
    return F.col(column) == F.lit(value) if value else None


def equals_upper(column: str, value: str | None) -> Column | None:
    return equals(column, value.upper()) if value else None


def between(column: str, low, high) -> Column | None:
    return F.col(column).between(low, high) if low and high else None


def one_of(column: str, values) -> Column | None:
    return F.col(column).isin(list(values)) if values else None


def contains_text(column: str, text: str | None) -> Column | None:
    """Case-insensitive containment; '%' and '_' in the text act as wildcards, as in SQL ILIKE."""
    return F.col(column).ilike(f"%{text}%") if text else None


def like_ignoring_case(column: str, pattern: str | None) -> Column | None:
    return F.col(column).ilike(pattern) if pattern else None


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the given predicates; none at all is TRUE."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))
