"""Links, context lines and source lists for result rows."""

from pyspark.sql import DataFrame, functions as F

from erario.functions import links
from erario.functions.fixed_values import CHAMBER_DATA, PORTAL, RESULT_LIMIT


def enrich(df: DataFrame) -> DataFrame:
    """Add the amendment link and, when there is an author id, the legislator link."""
    return df.withColumns(
        {
            "source_url": links.source_url(F.col("codigo_emenda")),
            "parlamentar_url": links.legislator_url(F.col("cod_autor")),
        }
    )


def context_lines(df: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """One text per question: its first rows in order, one numbered line each."""
    shown = [
        ("Autor: ", "nome_autor"), ("Partido: ", "partido"), ("UF: ", "uf"), ("Ano: ", "ano"),
        ("Função: ", "funcao_nome"), ("Subfunção: ", "subfuncao_nome"),
    ]
    money = [("Empenhado: R$ ", "valor_empenhado"), ("Pago: R$ ", "valor_pago")]
    parts = [
        F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in df.columns else F.lit("N/A"))
        for label, c in shown
    ] + [F.concat(F.lit(label), F.format_number(F.coalesce(F.col(c), F.lit(0)), 2)) for label, c in money]
    line = F.concat(F.col("posicao").cast("string"), F.lit(". "), F.concat_ws(" | ", *parts))
    numbered = df.filter(F.col("posicao") <= limit).select("id_consulta", "posicao", line.alias("linha"))
    return numbered.groupBy("id_consulta").agg(F.expr("listagg(linha, '\n') WITHIN GROUP (ORDER BY posicao)").alias("contexto"))


def sources(df: DataFrame) -> DataFrame:
    """Portals behind every question's rows: always the budget portal, the chamber when a row has a party."""
    party = F.max(F.coalesce(F.col("partido") != "", F.lit(False)))
    both = F.array(F.lit(PORTAL), F.lit(CHAMBER_DATA))
    return df.groupBy("id_consulta").agg(F.when(party, both).otherwise(F.array(F.lit(PORTAL))).alias("fontes"))
