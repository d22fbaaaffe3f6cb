"""Literal goldens of the scalar rules."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from erario.functions import dictionary, links, money, predicates as p, similarity, text


@pytest.mark.parametrize(
    "given, expected",
    [("1.234.567,89", "1234567.89"), ("1234.56", "123456.00"), ("", "0.00"), (None, "0.00"), ("-5,5", "-5.50"), ("7", "7.00")],
)
def test_parse_brl(column, given, expected):
    assert column(money.parse_brl(F.col("x")), row=(given,)) == Decimal(expected)


def test_parse_brl_of_no_amount_is_null(column):
    assert column(money.parse_brl(F.col("x")), row=("abc",)) is None


@pytest.mark.parametrize(
    "given, expected", [("1234.56", "1234.56"), ('"1.234,56"', "1234.56"), ('"1234.56"', "123456.00"), ("null", "0.00"), ('""', "0.00"), ("7", "7.00")]
)
def test_parse_brl_variant_tells_numbers_from_text(column, given, expected):
    assert column(money.parse_brl_variant(F.parse_json("x")), row=(given,)) == Decimal(expected)


@pytest.mark.parametrize(
    "given, expected",
    [(1234567.89, "R$ 1.234.567,89"), (None, "R$ 0,00"), (-5.0, "-R$ 5,00"), (1.999, "R$ 2,00"), (0.0, "R$ 0,00")],
)
def test_format_brl(column, given, expected):
    assert column(money.format_brl(F.col("x")), "x double", (given,)) == expected


def test_format_brl_inverts_parse_brl(spark):
    amounts = spark.range(-2000, 2000).select((F.col("id") * 12345 / 7).cast(money.AMOUNT).alias("v"))
    shown = F.replace(money.format_brl(F.col("v")), F.lit("R$ "), F.lit(""))
    assert amounts.filter(money.parse_brl(shown) != F.col("v")).count() == 0


@pytest.mark.parametrize("given, expected", [(0.8523, "85,23%"), (None, "0,00%"), (12.5, "1.250,00%")])
def test_format_percent(column, given, expected):
    assert column(money.format_percent(F.col("x")), "x double", (given,)) == expected


@pytest.mark.parametrize("given, expected", [(1234.0, "R$ 1,234.00"), (0.5, "R$ 0.50")])
def test_format_usd_style(column, given, expected):
    assert column(money.format_usd_style(F.col("x")), "x double", (given,)) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("ACRE (UF)", "AC"), ("MATO GROSSO DO SUL (UF)", "MS"), ("RIO BRANCO (MUN)", ""), ("ATLANTIDA (UF)", ""), ("", ""), (None, "")],
)
def test_extract_uf(column, given, expected):
    assert column(text.extract_uf(F.col("x")), row=(given,)) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("Saúde", "10"), ("SAÚDE E TRANSPORTE", "10"), ("Transporte e saneamento", "26"), ("Urbanismo", ""), ("", ""), (None, "")],
)
def test_function_code_takes_the_first_listed(column, given, expected):
    assert column(text.function_code(F.col("x")), row=(given,)) == expected


@pytest.mark.parametrize("given, expected", [("512 - Saneamento", "512"), ("Saneamento", ""), ("51", ""), (None, "")])
def test_subfunction_code(column, given, expected):
    assert column(text.subfunction_code(F.col("x")), row=(given,)) == expected


@pytest.mark.parametrize("given, expected", [("7", "007"), ("1234", "1234"), ("", "000"), (None, "000")])
def test_pad_code_never_shortens(column, given, expected):
    assert column(text.pad_code(F.col("x"), 3), row=(given,)) == expected


def test_clean_name_falls_back(column):
    assert column(text.clean_name(F.col("x"), F.lit(" ana ")), row=("",)) == "ANA"
    assert column(text.clean_name(F.col("x"), F.lit("b")), row=("\t joão \n",)) == "JOÃO"
    assert column(text.clean_name(F.col("x")), row=(None,)) == ""


def test_amendment_text(column):
    parts = [F.lit("ANA"), F.lit("Saúde"), F.lit("  "), F.lit(None).cast("string")]
    composed = text.amendment_text(*parts, F.lit(None).cast("string"), F.lit(2024))
    assert column(composed) == "ANA | Saúde | UF: None | Ano: 2024"


def test_classification_texts(column):
    assert column(text.classification_text(F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit("d"))) == "a b None d"
    assert column(text.classification_description(F.lit("a"), F.lit(None).cast("string"), F.lit("c"))) == "a -  - c"


@pytest.mark.parametrize(
    "given, expected", [("2024-03-01", "01/03/2024"), ("2024-03-01T10:20:30", "01/03/2024"), ("ontem", "ontem"), ("2024", "2024"), (None, "")]
)
def test_format_date(column, given, expected):
    assert column(text.format_date(F.col("x")), row=(given,)) == expected


def test_links(column):
    detail = "https://portaldatransparencia.gov.br/emendas/detalhe?codigoEmenda=202011970001"
    assert column(links.source_url(F.col("x")), row=("202011970001",)) == detail
    assert column(links.source_url(F.col("x"))) == "https://portaldatransparencia.gov.br/emendas/consulta"
    assert column(links.legislator_url(F.col("x")), "x int", (99,)) == "https://www.camara.leg.br/deputados/99"
    assert column(links.legislator_url(F.col("x")), "x int", (None,)) is None


@pytest.mark.parametrize(
    "term, expected", [("saúde", "10"), (" SAUDE ", "10"), ("hospital", "10"), ("escola", "12"), ("xyz_inexistente", None)]
)
def test_resolve_function(column, term, expected):
    assert column(dictionary.resolve_function(F.col("x")), row=(term,)) == expected


@pytest.mark.parametrize(
    "term, expected", [("saneamento basico", "512"), ("posto de saude", "301"), ("rodovia", "782"), ("atenção básica", "301"), ("escola", "12")]
)
def test_resolve_area_prefers_the_subfunction(column, term, expected):
    assert column(dictionary.resolve_area(F.col("x")), row=(term,)) == expected


def test_resolve_places(column):
    assert column(dictionary.resolve_region(F.col("x")), row=("Norte",)) == ["AC", "AM", "AP", "PA", "RO", "RR", "TO"]
    assert column(dictionary.resolve_region(F.col("x")), row=("inexistente",)) is None
    assert column(dictionary.resolve_uf(F.col("x")), row=("sul",)) == ["PR", "RS", "SC"]
    assert column(dictionary.resolve_uf(F.col("x")), row=("Acre",)) == ["AC"]
    assert column(dictionary.resolve_uf(F.col("x")), row=("São Paulo",)) == ["SÃ"]


def test_empty_filters_mean_no_filter(spark):
    nothing = [p.equals("a", 0), p.equals("a", ""), p.between("a", 2020, None), p.one_of("a", []), p.contains_text("a", "")]
    assert nothing == [None] * 5
    assert spark.range(3).filter(p.all_of(*nothing)).count() == 3


def test_cosine(column):
    schema = "a array<float>, b array<float>"
    assert column(similarity.cosine(F.col("a"), F.col("b")), schema, ([1.0, 0.0], [1.0, 1.0])) == pytest.approx(0.5**0.5)
    assert column(similarity.cosine_distance(F.col("a"), F.col("b")), schema, ([2.0, 0.0], [5.0, 0.0])) == pytest.approx(0)
    assert column(similarity.cosine(F.col("a"), F.col("b")), schema, ([0.0, 0.0], [5.0, 0.0])) is None
