"""Embeddings and vector search over (id, embedding) tables."""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from erario.functions.fixed_values import EMBEDDING_DIM, RESULT_LIMIT, SIMILARITY_THRESHOLD
from erario.operators.ranked_scan import NOT_A_CANDIDATE, ranked_scan

# Similarities are compared in billionths, so that ranks do not hang on the order of summation.
SCALE = 1_000_000_000


def pending(df: DataFrame) -> DataFrame:
    """Rows that have no embedding yet."""
    return df.filter(F.col("embedding").isNull())


def pending_by_key(df: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """As :func:`pending` when vectors live in their own table."""
    return df.join(vectors.filter(F.col("embedding").isNotNull()).select(key), key, "left_anti")


def embed(df: DataFrame, text: str = "texto", dim: int = EMBEDDING_DIM, encoder: Callable | None = None) -> DataFrame:
    """Add a unit-length ``embedding``.

    Without an encoder, words are hashed into ``dim`` counts on the JVM.  An
    encoder is a zero-argument factory, called once per task, that returns a
    function from a list of texts to a matrix.
    """
    if encoder is not None:
        return df.withColumn("embedding", _model_udf(encoder)(F.col(text)))
    words = RegexTokenizer(inputCol=text, outputCol="_palavras", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1)
    counts = HashingTF(inputCol="_palavras", outputCol="_contagens", numFeatures=dim)
    unit = Normalizer(inputCol="_contagens", outputCol="_unitario", p=2.0)
    hashed = unit.transform(counts.transform(words.transform(df.na.fill("", [text]))))
    return hashed.withColumn("embedding", vector_to_array("_unitario", "float32")).drop("_palavras", "_contagens", "_unitario")


def _model_udf(factory: Callable) -> Callable:
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            matrix = np.asarray(model(texts.fillna("").tolist()), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = matrix / np.where(norms == 0, 1.0, norms)
            yield pd.Series(list(unit.astype(np.float32)))

    return encode


def write_back(df: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Fill missing embeddings from ``vectors``; stored ones stay."""
    fresh = vectors.select(key, F.col("embedding").alias("_novo"))
    joined = df.join(fresh, key, "left")
    return joined.withColumn("embedding", F.coalesce("embedding", "_novo")).drop("_novo")


def group_centroids(df: DataFrame, by: str) -> DataFrame:
    """Mean vector per group, aggregated as vectors (no explosion into coordinates)."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding"))))
    return df.groupBy(by).agg(mean.alias("embedding"))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, np.nan, norms)


def _question_matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.asarray(vectors.tolist(), dtype=np.float64))


def _corpus_matrix(chunk: pa.RecordBatch) -> np.ndarray:
    column = chunk.column("embedding")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1))


def _billionths(similarity: np.ndarray, threshold: float | None) -> np.ndarray:
    floor = -SCALE if threshold is None else round(threshold * SCALE)
    if threshold is not None:  # few pass: only those are rounded
        near = similarity >= (floor - 1) / SCALE
        found, scores = np.rint(similarity[near] * SCALE).astype(np.int64), np.full(similarity.shape, NOT_A_CANDIDATE)
        scores[near] = np.where(found >= floor, found, NOT_A_CANDIDATE)
        return scores
    scores = np.rint(np.nan_to_num(similarity, nan=-2.0) * SCALE).astype(np.int64)
    return np.where(scores >= floor, scores, NOT_A_CANDIDATE)


def _cosine_scorer(threshold: float | None, keyed: bool, filtered: bool = False) -> Callable:
    """Scores by cosine; with keys, a pair counts only when the row's key is one of the question's, with filters, when the row has the question's bit."""

    def prepare(block: pd.DataFrame) -> Callable:
        directions = _question_matrix(block["embedding"]).T
        if filtered:
            return _bit_scorer(directions, block["filtro"].to_numpy(), threshold)
        if not keyed:
            return lambda chunk: _billionths(_corpus_matrix(chunk) @ directions, threshold)
        askers: dict = {}
        for column, keys in enumerate(block["chaves"]):
            for key in _plain(keys):
                askers.setdefault(key, []).append(column)

        def score(chunk: pa.RecordBatch) -> np.ndarray:
            scores = np.full((chunk.num_rows, directions.shape[1]), NOT_A_CANDIDATE)
            unit = _corpus_matrix(chunk)
            for key, rows in _rows_by_key(chunk):
                if key in askers:
                    columns = askers[key]
                    scores[np.ix_(rows, columns)] = _billionths(unit[rows] @ directions[:, columns], threshold)
            return scores

        return score

    return prepare


def _bit_scorer(directions: np.ndarray, filters: np.ndarray, threshold: float | None) -> Callable:
    """Scores pairs of a row and a question whose bit it has; rows without any of the block's bits are left out before."""
    words, shifts = filters // 64, (filters % 64).astype(np.uint64)

    def score(chunk: pa.RecordBatch) -> np.ndarray:
        scores = np.full((chunk.num_rows, directions.shape[1]), NOT_A_CANDIDATE)
        bits = chunk.column("filtros").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(chunk.num_rows, -1)
        passes = (bits[:, words] >> shifts & np.uint64(1)).astype(bool)
        rows = np.flatnonzero(passes.any(axis=1))
        if len(rows):
            found = _billionths(_corpus_matrix(chunk.take(pa.array(rows))) @ directions, threshold)
            scores[rows] = np.where(passes[rows], found, NOT_A_CANDIDATE)
        return scores

    return score


def _plain(keys) -> list:
    return np.asarray(keys).tolist()


def _rows_by_key(chunk: pa.RecordBatch):
    keys = chunk.column("chave").to_pandas()
    return keys.groupby(keys).indices.items()


def semantic_topk(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = RESULT_LIMIT,
    threshold: float | None = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """(id_consulta, id, similaridade, posicao): the k most similar corpus rows of every question.

    ``questions``: id_consulta, embedding; ``corpus``: id, embedding.  A
    ``chave`` column in the corpus together with a ``chaves`` array in the
    questions limits each question to rows with one of its keys; a ``filtros``
    bit set (long words) together with a ``filtro`` number, to rows with that
    bit.  Rows without an embedding and rows below the threshold are out; ties go to the lower id.
    """
    keyed = "chave" in corpus.columns and "chaves" in questions.columns
    filtered = "filtros" in corpus.columns and "filtro" in questions.columns
    columns = ["id", "embedding"] + (["chave"] if keyed else []) + (["filtros"] if filtered else [])
    rows = corpus.select(*columns).filter(F.col("embedding").isNotNull())
    asked = questions.select("id_consulta", "embedding", *(["chaves"] if keyed else []), *(["filtro"] if filtered else []))
    if keyed:
        rows = _of_asked_keys(rows, asked)
    ranked = ranked_scan(rows, asked, _cosine_scorer(threshold, keyed, filtered), k)
    return ranked.select("id_consulta", "id", (F.col("pontos") / SCALE).alias("similaridade"), "posicao")


LISTED_KEYS = 4096


def _of_asked_keys(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows with a key that some question has.  Few keys stand in the plan, where they prune the partitions of a stored table; many are joined."""
    keys = asked.select(F.explode("chaves").alias("chave")).distinct()
    listed = [r["chave"] for r in keys.limit(LISTED_KEYS + 1).collect()]
    if len(listed) <= LISTED_KEYS:
        return rows.filter(F.col("chave").isin(listed))
    return rows.join(keys, "chave", "left_semi").select(*rows.columns)


def with_attributes(ranked: DataFrame, table: DataFrame) -> DataFrame:
    """Join table columns to ranked ids after the cut.

    The ranked side holds k rows per question; Spark broadcasts it when that turns
    out to be little.
    """
    return table.join(ranked, "id")


def nearest_classification(terms: DataFrame, classification: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Function code of the most similar classification per term; null below the threshold.

    ``terms``: id_consulta, embedding; ``classification``: id, funcao, embedding.
    """
    nearest = semantic_topk(terms, classification, k=1, threshold=None)
    named = classification.select("id", "funcao").join(nearest, "id")
    code = F.when(F.col("similaridade") >= threshold, F.col("funcao"))
    chosen = named.select("id_consulta", "similaridade", code.alias("funcao"))
    return terms.select("id_consulta").join(chosen, "id_consulta", "left")


def hybrid_prefilter(questions: DataFrame, corpus: DataFrame, selected: DataFrame, k: int = 5) -> DataFrame:
    """Rank only the selected corpus ids; no selected row means no result."""
    return semantic_topk(questions, corpus.join(selected.select("id"), "id", "left_semi"), k, threshold=None)


def hybrid_prefilter_filters(questions: DataFrame, corpus: DataFrame, passed: DataFrame, k: int = 5) -> DataFrame:
    """Rank for each question only the rows that its own filter set passes.

    ``questions``: id_consulta, embedding, filtro; ``passed``: id, filtros, the bit set of the
    filter sets a row passes (``questions.filter_bits``); rows in no set need not be there.
    """
    rows = corpus.join(passed.select("id", "filtros"), "id")
    return semantic_topk(questions, rows, k, threshold=None)


def rounded_texts(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Similarity at four places and the first 200 characters of the text, as a report shows them."""
    shown = texts.select("id", F.substring("texto", 1, 200).alias("texto"))
    return with_attributes(ranked.withColumn("similaridade", F.round("similaridade", 4)), shown)


def hybrid_fill(structured: DataFrame, questions: DataFrame, corpus: DataFrame, k: int = RESULT_LIMIT,
                threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Structured rows first; questions with fewer than k get similar rows they do not have yet.

    ``structured``: id_consulta, id, posicao (at most k per question).  The
    vector side ignores the filters, and only unfilled questions reach it.
    """
    full = structured.groupBy("id_consulta").agg(F.count("*").alias("_linhas")).filter(F.col("_linhas") >= k)
    asked = questions.join(full, "id_consulta", "left_anti")
    similar = semantic_topk(asked, corpus, k, threshold).join(structured, ["id_consulta", "id"], "left_anti")
    merged = structured.select("id_consulta", "id", "posicao", F.lit(0).alias("_fonte")).unionByName(
        similar.select("id_consulta", "id", "posicao", F.lit(1).alias("_fonte"), "similaridade"), allowMissingColumns=True
    )
    order = Window.partitionBy("id_consulta").orderBy("_fonte", "posicao")
    cut = merged.withColumn("_ordem", F.row_number().over(order)).filter(F.col("_ordem") <= k)
    origin = F.when(F.col("_fonte") == 0, F.lit("sql")).otherwise(F.lit("vetorial"))
    return cut.select("id_consulta", "id", origin.alias("origem"), "similaridade", F.col("_ordem").alias("posicao"))


def hyperplanes(bits: int, dim: int, seed: int = 7) -> np.ndarray:
    """Random directions whose signs name the cell of a vector."""
    return np.random.RandomState(seed).standard_normal((bits, dim)).round(6)


def cell_of(vector: Column, bits: int, dim: int, seed: int = 7) -> Column:
    """Cell number: bit i is set when the vector lies on the positive side of direction i."""
    planes = hyperplanes(bits, dim, seed).T

    @F.pandas_udf("int")
    def assign(vectors: pd.Series) -> pd.Series:
        side = np.asarray(vectors.tolist(), dtype=np.float64) @ planes > 0
        return pd.Series(side @ (1 << np.arange(bits)))

    return assign(vector)


def with_cells(vectors: DataFrame, bits: int, dim: int, seed: int = 7) -> DataFrame:
    """Vectors with their cell as ``chave``; writing them partitioned by it lets a search skip cells."""
    filled = vectors.filter(F.col("embedding").isNotNull())
    return filled.withColumn("chave", cell_of(F.col("embedding"), bits, dim, seed))


def cells_near(cell: Column, bits: int, radius: int) -> Column:
    """All cells whose number differs from ``cell`` in at most ``radius`` bits: the cell with every choice of so many bits flipped."""
    flips = [sum(1 << bit for bit in chosen) for n in range(min(radius, bits) + 1) for chosen in combinations(range(bits), n)]
    return F.transform(F.array(*map(F.lit, flips)), lambda flip: cell.bitwiseXOR(flip))


def approximate_topk(
    questions: DataFrame,
    cells: DataFrame,
    bits: int,
    dim: int,
    radius: int = 1,
    k: int = RESULT_LIMIT,
    threshold: float | None = SIMILARITY_THRESHOLD,
    seed: int = 7,
) -> DataFrame:
    """Top-k among the rows in cells near the question's own; exact cosine decides the ranks.

    ``cells`` comes from :func:`with_cells` with the same bits and seed.  Every
    row has one cell, so candidates need no duplicate removal.  A larger radius
    finds more and reads more; ``radius = bits`` is the exact search.
    """
    own = questions.withColumn("_celula", cell_of(F.col("embedding"), bits, dim, seed))
    asked = own.withColumn("chaves", cells_near(F.col("_celula"), bits, radius)).drop("_celula")
    return semantic_topk(asked, cells, k, threshold)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact result that an approximate search found, per question."""
    hit = found.select("id_consulta", "id", F.lit(1).alias("_achada"))
    return (
        exact.join(hit, ["id_consulta", "id"], "left")
        .groupBy("id_consulta")
        .agg(F.count("*").alias("exatas"), F.count("_achada").alias("achadas"))
        .withColumn("revocacao", F.round(F.col("achadas") / F.col("exatas"), 4))
    )
