"""Keyword search: rank texts by how many distinct words of a question they hold."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from erario.functions.fixed_values import RESULT_LIMIT
from erario.operators.ranked_scan import NOT_A_CANDIDATE, ranked_scan

PRESENCE_CELLS = 4_000_000


def words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def searchable_text(amendments: DataFrame) -> Column:
    """The concatenated text that keyword search looks at."""
    names = [c for c in ("nome_autor", "funcao_nome", "subfuncao_nome", "descricao") if c in amendments.columns]
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in names])


def _match_scorer(block: pd.DataFrame):
    """Number of question words present, as a product of two 0/1 matrices over the questions' vocabulary."""
    vocabulary = pd.Index(sorted({word for terms in block["palavras"] for word in terms}))
    wanted = np.zeros((len(vocabulary), len(block)), dtype=np.float32)
    for column, terms in enumerate(block["palavras"]):
        wanted[vocabulary.get_indexer(list(terms)), column] = 1
    known = pa.array(vocabulary.to_list(), type=pa.string())
    step = max(1, PRESENCE_CELLS // max(1, len(vocabulary)))

    def score(chunk: pa.RecordBatch) -> np.ndarray:
        counts = [_counts(chunk.slice(start, step)) for start in range(0, chunk.num_rows, step)]
        return np.concatenate(counts)

    def _counts(part: pa.RecordBatch) -> np.ndarray:
        column = part.column("palavras")
        place = pc.index_in(column.flatten(), value_set=known)
        row = pc.list_parent_indices(column).to_numpy()
        hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
        present = np.zeros((part.num_rows, len(vocabulary)), dtype=np.float32)
        present[row[hit], place.drop_null().to_numpy()] = 1
        matched = np.rint(present @ wanted).astype(np.int64)
        return np.where(matched > 0, matched, NOT_A_CANDIDATE)

    return score


def keyword_topk(questions: DataFrame, corpus: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """(id_consulta, id, termos, posicao): texts holding most question words; ties go to the lower id.

    ``questions``: id_consulta, texto; ``corpus``: id, texto.  Whole texts are
    split on the JVM; frequent words cost nothing extra, as no (text, question)
    pair leaves its task unless it is among the k best there.
    """
    asked = questions.select("id_consulta", words(F.col("texto")).alias("palavras"))
    rows = corpus.select("id", words(F.col("texto")).alias("palavras"))
    ranked = ranked_scan(rows, asked, _match_scorer, k)
    return ranked.select("id_consulta", "id", F.col("pontos").alias("termos"), "posicao")
