"""Conjunctive filters over amendments, and the joins they need."""

from pyspark.sql import DataFrame, functions as F

from erario.functions import predicates as p


def with_party(amendments: DataFrame, legislators: DataFrame) -> DataFrame:
    """Amendments left-joined to their legislator's party; the dimension is pruned to two columns.

    No broadcast hint: Spark broadcasts the legislators when their size allows
    it and otherwise shuffles both sides, splitting skewed authors.
    """
    return amendments.join(legislators.select("cod_autor", "partido"), "cod_autor", "left")


def dynamic_filter(df: DataFrame, filters: dict) -> DataFrame:
    """AND of the given filters; unknown, missing or empty entries filter nothing.

    Keys: ano, ano_inicio + ano_fim, uf, ufs, autor, partido, funcao, subfuncao,
    tipo_emenda.  ``partido`` needs the column added by :func:`with_party`.
    """
    get = filters.get
    return df.filter(
        p.all_of(
            p.equals("ano", get("ano")),
            p.between("ano", get("ano_inicio"), get("ano_fim")),
            p.equals("uf", get("uf")),
            p.one_of("uf", get("ufs")),
            p.contains_text("nome_autor", get("autor")),
            p.equals("partido", get("partido")),
            p.equals("funcao", get("funcao")),
            p.equals("subfuncao", get("subfuncao")),
            p.contains_text("tipo_emenda", get("tipo_emenda")),
        )
    )


def filter_with_party(amendments: DataFrame, legislators: DataFrame, filters: dict) -> DataFrame:
    """Filtered amendments with their party; every filter but the party's is applied before the join."""
    own = {k: v for k, v in filters.items() if k != "partido"}
    joined = with_party(dynamic_filter(amendments, own), legislators)
    return dynamic_filter(joined, {"partido": filters.get("partido")})


def restrict_to(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the selected set."""
    return df.join(selected.select(key), key, "left_semi")


def movement_totals(movements: DataFrame, phases: list[str]) -> DataFrame:
    """Total value per amendment and phase, one column per phase."""
    return (
        movements.groupBy("emenda_id")
        .agg(*[F.sum(F.when(F.col("fase") == phase, F.col("valor"))).alias(phase) for phase in phases])
        .na.fill(0, phases)
    )


def with_movements(amendments: DataFrame, movements: DataFrame, phases: list[str]) -> DataFrame:
    """Amendments with their movement totals; movements are aggregated before the join."""
    totals = movement_totals(movements, phases).withColumnRenamed("emenda_id", "id")
    return amendments.join(totals, "id", "left").na.fill(0, phases)
