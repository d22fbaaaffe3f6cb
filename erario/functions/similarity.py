"""Vector similarity as a column expression."""

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null when one has length zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _dot(a, b) / F.nullif(norms, F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)
