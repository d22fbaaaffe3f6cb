"""Raw API records -> the fixed amendment, legislator and classification columns."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StructType, VariantType

from erario.functions import money, text
from erario.functions.fixed_values import DEFAULT_LEGISLATURE, SOURCE_NAME

AMOUNT_COLUMNS = ["valor_empenhado", "valor_liquidado", "valor_pago"]


def _raw_text(raw: DataFrame, field: str) -> Column:
    return F.coalesce(F.col(field), F.lit("")) if field in raw.columns else F.lit("")


def _raw_amount(raw: DataFrame, field: str) -> Column:
    """Amount of a raw field that may be missing, VARIANT, numeric or text."""
    if field not in raw.columns:
        return F.lit(0).cast(money.AMOUNT)
    kind = raw.schema[field].dataType
    if isinstance(kind, VariantType):
        return money.parse_brl_variant(F.col(field))
    if isinstance(kind, NumericType):
        return money.default_amount(F.col(field).cast(money.AMOUNT))
    return money.parse_brl(F.col(field))


def normalize_amendments(raw: DataFrame, *keep: str) -> DataFrame:
    """One projection from raw records to amendments; ``keep`` names extra columns to carry along."""
    place, function, subfunction = (_raw_text(raw, f) for f in ("localidadeDoGasto", "funcao", "subfuncao"))
    authors = [F.col(f) for f in ("nomeAutor", "autor") if f in raw.columns]
    return raw.select(
        F.col("codigoEmenda").alias("codigo_emenda"),
        text.clean_name(*authors).alias("nome_autor"),
        F.col("ano").cast("int").alias("ano"),
        _raw_text(raw, "tipoEmenda").alias("tipo_emenda"),
        text.function_code(function).alias("funcao"),
        function.alias("funcao_nome"),
        text.subfunction_code(subfunction).alias("subfuncao"),
        subfunction.alias("subfuncao_nome"),
        place.alias("localidade"),
        text.extract_uf(place).alias("uf"),
        _raw_amount(raw, "valorEmpenhado").alias("valor_empenhado"),
        _raw_amount(raw, "valorLiquidado").alias("valor_liquidado"),
        _raw_amount(raw, "valorPago").alias("valor_pago"),
        _raw_text(raw, "nomeSubfuncao").alias("descricao"),
        F.lit(SOURCE_NAME).alias("fonte"),
        *keep,
    )


def normalize_legislators(raw: DataFrame, *keep: str) -> DataFrame:
    legislature = F.coalesce(F.col("idLegislatura"), F.lit(DEFAULT_LEGISLATURE)).cast("int")
    return raw.select(
        F.col("id").alias("cod_autor"),
        F.upper("nome").alias("nome"),
        _raw_text(raw, "siglaPartido").alias("partido"),
        _raw_text(raw, "siglaUf").alias("uf"),
        _raw_text(raw, "urlFoto").alias("url_foto"),
        F.array(legislature).alias("legislaturas"),
        *keep,
    )


def normalize_classification(raw: DataFrame, *keep: str) -> DataFrame:
    return raw.select(
        text.pad_code(F.col("CodFuncao"), 2).alias("funcao"),
        _raw_text(raw, "Funcao").alias("funcao_nome"),
        text.pad_code(F.col("CodSubfuncao"), 3).alias("subfuncao"),
        _raw_text(raw, "Subfuncao").alias("subfuncao_nome"),
        _raw_text(raw, "CodPrograma").alias("programa"),
        _raw_text(raw, "Programa").alias("programa_nome"),
        text.classification_description(F.col("Funcao"), F.col("Subfuncao"), F.col("Programa")).alias("descricao"),
        *keep,
    )


def default_amounts(amendments: DataFrame) -> DataFrame:
    """Missing amounts read 0."""
    present = [c for c in AMOUNT_COLUMNS if c in amendments.columns]
    return amendments.withColumns({c: money.default_amount(F.col(c)) for c in present})


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a stored table in its types and order; what ``df`` lacks is null, amounts are 0."""
    fields = StructType.fromDDL(schema).fields
    shaped = df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    return default_amounts(shaped)
