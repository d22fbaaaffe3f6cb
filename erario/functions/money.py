"""Money columns: reading Brazilian money text and writing it back."""

from pyspark.sql import Column, functions as F

AMOUNT = "decimal(15,2)"


def parse_brl(text: Column) -> Column:
    """'1.234.567,89' -> 1234567.89; null and '' -> 0; text that is no amount -> null.

    Every '.' is a thousands mark, so the *text* '1234.56' reads 123456.00.
    """
    plain = F.translate(text, ",.", ".")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast(AMOUNT)).otherwise(plain.try_cast(AMOUNT))


def parse_brl_variant(value: Column) -> Column:
    """As :func:`parse_brl` for a VARIANT field: numbers pass through, text is parsed."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", AMOUNT)
    return F.when(value.isNull() | (kind == "VOID") | (kind == "STRING"), parse_brl(text)).otherwise(number)


def default_amount(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(AMOUNT))


def _swap_marks(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def format_brl(value: Column) -> Column:
    """1234567.89 -> 'R$ 1.234.567,89', -5 -> '-R$ 5,00', null -> 'R$ 0,00'."""
    amount = F.coalesce(value.cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))
    text = F.concat(F.lit("R$ "), _swap_marks(F.format_number(F.abs(amount), 2)))
    return F.when(amount < 0, F.concat(F.lit("-"), text)).otherwise(text)


def format_percent(value: Column) -> Column:
    """0.8523 -> '85,23%', null -> '0,00%'."""
    share = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.concat(_swap_marks(F.format_string("%,.2f", share * 100)), F.lit("%"))


def format_usd_style(value: Column) -> Column:
    """1234 -> 'R$ 1,234.00' (en-US marks)."""
    return F.concat(F.lit("R$ "), F.format_number(value.cast("decimal(38,2)"), 2))
