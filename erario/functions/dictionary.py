"""Lookups in the fixed budget dictionary, as column expressions."""

from pyspark.sql import Column, functions as F

from erario.functions.fixed_values import FUNCTION_TERMS, REGION_STATES, SUBFUNCTION_TERMS
from erario.functions.text import literal_map, strip


def _term(raw: Column) -> Column:
    return strip(F.lower(raw))


def resolve_function(term: Column) -> Column:
    return F.try_element_at(literal_map(FUNCTION_TERMS), _term(term))


def resolve_subfunction(term: Column) -> Column:
    return F.try_element_at(literal_map(SUBFUNCTION_TERMS), _term(term))


def resolve_area(term: Column) -> Column:
    """The more specific subfunction first, then the function."""
    return F.coalesce(resolve_subfunction(term), resolve_function(term))


def resolve_region(name: Column) -> Column:
    """State codes of a region; null for any other name."""
    pairs = [(F.lit(region), F.array(*map(F.lit, states))) for region, states in REGION_STATES.items()]
    return F.try_element_at(F.create_map(*[x for pair in pairs for x in pair]), _term(name))


def resolve_uf(raw: Column) -> Column:
    """States of a region, else the first two letters as one state code."""
    return F.coalesce(resolve_region(raw), F.array(F.substring(F.upper(raw), 1, 2)))
