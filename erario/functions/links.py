"""Provenance links to the public portals."""

from pyspark.sql import Column, functions as F

from erario.functions.fixed_values import CHAMBER_LEGISLATOR, PORTAL_DETAIL, PORTAL_SEARCH


def source_url(code: Column) -> Column:
    """Detail page of an amendment code; the search page when there is no code."""
    return F.when(code != "", F.concat(F.lit(PORTAL_DETAIL), code)).otherwise(F.lit(PORTAL_SEARCH))


def legislator_url(author_id: Column) -> Column:
    """Chamber page of a legislator; null when there is none."""
    return F.when(author_id != 0, F.concat(F.lit(CHAMBER_LEGISLATOR), author_id.cast("string")))
