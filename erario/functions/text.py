"""Text and code columns: names, states, budget codes, embedding texts, dates."""

from pyspark.sql import Column, functions as F

from erario.functions.fixed_values import FUNCTION_CODES, STATE_CODES


WHITESPACE = " \t\n\r\f\v"


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of white space; a bare trim only removes spaces."""
    return F.trim(text, F.lit(WHITESPACE))


def clean_name(*candidates: Column) -> Column:
    """First non-empty candidate, trimmed and upper-cased; no candidate gives ''."""
    picked = F.coalesce(*[F.when(c != "", c) for c in candidates], F.lit(""))
    return F.upper(strip(picked))


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant lookup map; only for the fixed lists, which have at most 68 entries."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def extract_uf(place: Column) -> Column:
    """'ACRE (UF)' -> 'AC'; any other ending and any unknown state give ''."""
    name = strip(F.replace(place, F.lit(" (UF)"), F.lit("")))
    code = F.try_element_at(literal_map(STATE_CODES), name)
    return F.when(place.endswith("(UF)"), _blank(code)).otherwise(F.lit(""))


def function_code(text: Column) -> Column:
    """Code of the first listed function name contained in the text, ignoring case; else ''."""
    lowered = F.lower(text)
    return F.coalesce(
        *[F.when(F.contains(lowered, F.lit(name.lower())), F.lit(code)) for name, code in FUNCTION_CODES.items()],
        F.lit(""),
    )


def subfunction_code(text: Column) -> Column:
    """The three leading digits, else ''."""
    return F.regexp_extract(_blank(text), r"^([0-9]{3})", 1)


def pad_code(code: Column, width: int) -> Column:
    """Zero-fill on the left; longer codes are kept whole (a bare lpad would cut them)."""
    text = _blank(code.cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def classification_description(function: Column, subfunction: Column, programme: Column) -> Column:
    return F.concat_ws(" - ", _blank(function), _blank(subfunction), _blank(programme))


def amendment_text(
    author: Column, function: Column, subfunction: Column, description: Column, uf: Column, year: Column
) -> Column:
    """Text that stands for an amendment in vector search; blank parts are left out.

    A missing state or year keeps its label and reads 'None', as in the published texts.
    """
    parts = [F.when(strip(p) != "", p) for p in (author, function, subfunction, description)]
    labelled = [
        F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("None")))
        for label, value in (("UF: ", uf), ("Ano: ", year))
    ]
    return F.concat_ws(" | ", *parts, *labelled)


def amendment_text_short(author: Column, function: Column, subfunction: Column, place: Column, year: Column) -> Column:
    """Five-part variant with the place instead of description and state; nothing is left out."""
    none = F.lit("None")
    parts = [F.coalesce(p.cast("string"), none) for p in (author, function, subfunction, place)]
    return F.concat_ws(" | ", *parts, F.concat(F.lit("Ano: "), F.coalesce(year.cast("string"), none)))


def classification_text(function: Column, subfunction: Column, programme: Column, description: Column) -> Column:
    """Text that stands for a budget classification; a missing part reads 'None'."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("None")) for p in (function, subfunction, programme, description)])


def format_date(value: Column) -> Column:
    """dd/MM/yyyy; null gives '' and text that is no date is returned unchanged."""
    text = value.cast("string")
    parsed = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.try_to_timestamp(text))
    return F.coalesce(F.date_format(parsed, "dd/MM/yyyy"), text, F.lit(""))
