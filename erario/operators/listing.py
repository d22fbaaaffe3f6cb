"""Sorted, limited and paged listings; every order ends in a unique key."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from erario.functions import links, predicates as p
from erario.functions.fixed_values import RESULT_LIMIT
from erario.operators.filters import dynamic_filter, filter_with_party, with_party

SEARCH_COLUMNS = [
    "id", "codigo_emenda", "cod_autor", "nome_autor", "ano", "tipo_emenda", "funcao_nome", "subfuncao_nome",
    "uf", "localidade", "valor_empenhado", "valor_liquidado", "valor_pago", "partido",
]
SORT_FIELDS = ["nome_autor", "partido", "uf", "funcao_nome", "valor_empenhado", "valor_pago", "ano"]
MAX_PAGE_SIZE = 100


def _by_amount(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("valor_empenhado").desc_nulls_last(), F.col("id").asc())


def _top_with_party(amendments, legislators, filters, offset, limit) -> DataFrame:
    """Cut before the party join unless the party is itself a filter.

    The join loses the order of the cut, so its few rows are sorted again.  The
    rows before the page are dropped only then: an offset below a join makes
    adaptive execution take the second sort for needless and leave it out.
    """
    if filters.get("partido"):
        joined = filter_with_party(amendments, legislators, filters)
    else:
        joined = with_party(_by_amount(dynamic_filter(amendments, filters)).limit(offset + limit), legislators)
    return _by_amount(joined).offset(offset).limit(limit)


def _page_offset(page: int, page_size: int) -> int:
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and page_size between 1 and {MAX_PAGE_SIZE}")
    return (page - 1) * page_size


def search(amendments: DataFrame, legislators: DataFrame, filters: dict, limit: int = RESULT_LIMIT) -> DataFrame:
    """The largest amendments that pass the filters, with party."""
    top = _top_with_party(amendments, legislators, filters, 0, limit)
    return top.select([c for c in SEARCH_COLUMNS if c in top.columns])


def _upper_keys(filters: dict) -> dict:
    return {k: v.upper() if k in ("uf", "partido") and v else v for k, v in filters.items()}


def list_amendments(
    amendments: DataFrame, legislators: DataFrame, filters: dict, page: int = 1, page_size: int = 20
) -> DataFrame:
    """One page of amendments with party and links."""
    offset = _page_offset(page, page_size)
    rows = _top_with_party(amendments, legislators, _upper_keys(filters), offset, page_size)
    return rows.select(
        *[c for c in SEARCH_COLUMNS if c in rows.columns],
        links.source_url(F.col("codigo_emenda")).alias("source_url"),
        links.legislator_url(F.col("cod_autor")).alias("parlamentar_url"),
    )


def count_amendments(amendments: DataFrame, legislators: DataFrame, filters: dict) -> DataFrame:
    """Total behind the pages; the party join only happens when the party is filtered."""
    given = _upper_keys(filters)
    rows = filter_with_party(amendments, legislators, given) if given.get("partido") else dynamic_filter(amendments, given)
    return rows.agg(F.count("*").alias("total"))


def _legislator_rows(legislators: DataFrame, nome, partido, uf) -> DataFrame:
    return legislators.filter(
        p.all_of(p.contains_text("nome", nome), p.equals_upper("partido", partido), p.equals_upper("uf", uf))
    )


def list_legislators(
    legislators: DataFrame, nome=None, partido=None, uf=None, page: int = 1, page_size: int = 20
) -> DataFrame:
    """One page of legislators by name."""
    offset = _page_offset(page, page_size)
    return _legislator_rows(legislators, nome, partido, uf).orderBy("nome", "cod_autor").offset(offset).limit(page_size)


def count_legislators(legislators: DataFrame, nome=None, partido=None, uf=None) -> DataFrame:
    return _legislator_rows(legislators, nome, partido, uf).agg(F.count("*").alias("total"))


def sort_by(df: DataFrame, field: str = "valor_empenhado", ascending: bool = False, page: int = 0, page_size: int = 20) -> DataFrame:
    """One page of rows ordered by one of seven fields; missing text sorts as ''."""
    if field not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {field!r}")
    is_text = isinstance(df.schema[field].dataType, StringType)
    value = F.coalesce(F.col(field), F.lit("")) if is_text else F.col(field)
    order = value.asc_nulls_first() if ascending else value.desc_nulls_last()
    return df.orderBy(order, F.col("id").asc()).offset(page * page_size).limit(page_size)
