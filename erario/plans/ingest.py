"""Raw records to stored amendments, and the embedding of what is new."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from erario.functions.fixed_values import EMBEDDING_DIM
from erario.functions.text import amendment_text, classification_text
from erario.operators import integrity, normalize, vectors
from erario.sources.partitions import complete, stage
from erario.sources.writers import written


def prepare_amendments(raw: DataFrame, legislators: DataFrame, order: list[str]) -> DataFrame:
    """Normalised, valid, one row per code (the first in ``order``), linked to their authors.

    A load reads the linked rows several times, so they are written to the shared
    scratch folder once.  Linking takes the names from the rows before the
    deduplication, which then need not be written.
    """
    extra = [c for c in order if c != "ano"]
    rows = integrity.drop_invalid_codes(normalize.normalize_amendments(raw, *extra))
    first = integrity.dedup_first(rows, "codigo_emenda", order).drop(*extra)
    return written(integrity.link_author(first, legislators, rows), "vinculadas")


def load_amendments(raw: DataFrame, legislators: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """The new snapshot after an upsert that keeps stored vectors."""
    return integrity.upsert_keep(stored, prepare_amendments(raw, legislators, order), "codigo_emenda")


def load_partitions(raw: DataFrame, legislators: DataFrame, path: str, order: list[str]) -> bool:
    """``load_amendments`` into the table at ``path``, rewriting only the years it touches; True if rows came in.

    What an interrupted run left is completed or discarded first.
    """
    complete(raw.sparkSession, path)
    return stage(prepare_amendments(raw, legislators, order), path, "codigo_emenda") and complete(raw.sparkSession, path)


def insert_amendments(raw: DataFrame, legislators: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """The new snapshot when stored codes stay as they are and only new ones are added."""
    return integrity.insert_if_absent(stored, prepare_amendments(raw, legislators, order), "codigo_emenda")


def load_legislators(raw: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """The new legislators; a person listed several times counts as last listed, replacing what was stored."""
    rows = normalize.normalize_legislators(raw, *order)
    last = written(integrity.dedup_last(rows, "cod_autor", order).drop(*order), "parlamentares")
    return integrity.upsert(stored, last, "cod_autor")


def text_of(amendments: DataFrame) -> Column:
    parts = ["nome_autor", "funcao_nome", "subfuncao_nome", "descricao", "uf", "ano"]
    return amendment_text(*[F.col(c) if c in amendments.columns else F.lit(None).cast("string") for c in parts])


def new_vectors(
    amendments: DataFrame, stored: DataFrame, key: str = "id", dim: int = EMBEDDING_DIM, encoder: Callable | None = None
) -> DataFrame:
    """(key, texto, embedding) of the amendments without a stored vector; append it to the vector table."""
    waiting = vectors.pending_by_key(amendments, stored, key)
    return vectors.embed(waiting.select(key, text_of(waiting).alias("texto")), dim=dim, encoder=encoder)


def new_classification_vectors(
    classification: DataFrame, stored: DataFrame, key: str = "id", dim: int = EMBEDDING_DIM, encoder: Callable | None = None
) -> DataFrame:
    """(key, funcao, texto, embedding) of the classifications without a stored vector."""
    waiting = vectors.pending_by_key(classification, stored, key)
    names = [F.col(c) for c in ("funcao_nome", "subfuncao_nome", "programa_nome", "descricao")]
    return vectors.embed(waiting.select(key, "funcao", classification_text(*names).alias("texto")), dim=dim, encoder=encoder)
