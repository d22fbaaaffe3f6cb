"""Whole tables of questions, from text to ranked rows with sources, in a fixed number of jobs."""

from pyspark.sql import DataFrame, Window, functions as F

from erario.functions.fixed_values import EMBEDDING_DIM, PORTAL, RESULT_LIMIT, SIMILARITY_THRESHOLD
from erario.operators import aggregates, operations, present, questions as q, vectors as v
from erario.operators.filters import with_party
from erario.sources.writers import written


def interpret(questions: DataFrame, legislators: DataFrame) -> DataFrame:
    """(id_consulta, consulta) -> the same with ``entidades``; the dictionary is built once and read several times."""
    terms = written(q.question_dictionary(legislators), "dicionario")
    extracted = q.extract_entities(questions, terms)
    return q.entity_map(extracted).select("id_consulta", "consulta", "entidades")


def nearest_functions(interpreted: DataFrame, classification: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(area, funcao) for the areas the dictionary does not know, by vector similarity."""
    areas = q.unresolved_areas(interpreted).withColumn("id_consulta", F.col("area"))
    found = v.nearest_classification(v.embed(areas, "area", dim), classification, threshold)
    return found.select(F.col("id_consulta").alias("area"), "funcao")


def first_figures(figures: DataFrame, k: int) -> DataFrame:
    """(id_consulta, figuras): the first ``k`` figures of a question in one array; ``figures`` itself has all."""
    order = Window.partitionBy("id_consulta").orderBy(F.asc_nulls_last("posicao"), F.asc_nulls_last("ano"), F.asc_nulls_last("grupo"))
    first = figures.withColumn("_ordem", F.row_number().over(order)).filter(F.col("_ordem") <= k)
    entry = F.struct("_ordem", "operacao", "grupo", "ano", "valor", "pago", "qtd", "variacao", "posicao")
    listed = first.groupBy("id_consulta").agg(F.sort_array(F.collect_list(entry)).alias("figuras"))
    return listed.withColumn("figuras", F.transform("figuras", lambda e: e.dropFields("_ordem")))


def answer_questions(
    questions: DataFrame,
    amendments: DataFrame,
    legislators: DataFrame,
    classification: DataFrame | None = None,
    corpus: DataFrame | None = None,
    k: int = RESULT_LIMIT,
    threshold: float = SIMILARITY_THRESHOLD,
    dim: int = EMBEDDING_DIM,
) -> tuple[DataFrame, DataFrame]:
    """(answers, rows): one summary per question with the figures its operation asks for, and its ranked, linked rows.

    ``figuras`` holds the first ``k`` figures (:func:`operations.figures`); a plain search has none.

    Questions that bring an ``entidades`` map (parsed replies) are taken as
    interpreted; the others are interpreted by dictionary.  ``classification`` (id, funcao, embedding) and ``corpus`` (id, embedding)
    switch on the vector steps for areas that no dictionary resolves.  Frames
    used by several later steps are written to the shared scratch folder once.
    """
    ready = questions if "entidades" in questions.columns else interpret(questions, legislators)
    interpreted = written(ready.select("id_consulta", "consulta", "entidades"), "interpretadas")
    nearest = None if classification is None else nearest_functions(interpreted, classification, dim, threshold)
    filters = written(q.decompose(interpreted, nearest), "filtros")
    ranked = written(q.structured_ranks(filters, amendments, legislators, k), "posicoes")
    if corpus is not None:
        asked = filters.filter(F.col("termo_vetorial").isNotNull()).select("id_consulta", "termo_vetorial")
        ranked = v.hybrid_fill(ranked, v.embed(asked, "termo_vetorial", dim), corpus, k, threshold)
    rows = written(with_party(amendments.join(ranked, "id"), legislators), "linhas")

    figures = first_figures(operations.figures(filters, amendments, legislators, k), k)
    context = present.context_lines(rows, k)
    answers = (
        q.answer_summary(filters, rows)
        .join(interpreted, "id_consulta")
        .join(context, "id_consulta", "left")
        .join(present.sources(rows), "id_consulta", "left")
        .join(figures, "id_consulta", "left")
        .withColumns(
            {
                "contexto": F.coalesce("contexto", F.lit("Nenhum dado encontrado.")),
                "fontes": F.coalesce("fontes", F.array(F.lit(PORTAL))),
            }
        )
    )
    return answers, present.enrich(rows)


def score_extraction(questions: DataFrame, legislators: DataFrame) -> DataFrame:
    """(id_consulta, consulta, esperado) -> hits and precision of the extracted entities."""
    found = interpret(questions.select("id_consulta", "consulta"), legislators)
    return q.verify_entities(found.join(questions.select("id_consulta", "esperado"), "id_consulta"))


def evaluation_report(scored: DataFrame, log: DataFrame) -> DataFrame:
    """Precision and latency per question class; ``log``: id_consulta, latencia_ms, sucesso."""
    results = scored.join(log, "id_consulta").withColumnRenamed("id_consulta", "id")
    return aggregates.class_report(results)
