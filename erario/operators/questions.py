"""Whole tables of questions: extraction, decomposition, retrieval, scoring."""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from erario.functions import dictionary
from erario.functions.fixed_values import (
    AMENDMENT_TYPE_TERMS,
    FUNCTION_TERMS,
    OPERATION_TERMS,
    REGION_STATES,
    RESULT_LIMIT,
    STATE_CODES,
    SUBFUNCTION_TERMS,
)
from erario.functions.text import strip
from erario.operators.filters import with_party
from erario.sources.writers import join_side, written

FILTER_SCHEMA = {
    "ano": "int", "ano_inicio": "int", "ano_fim": "int", "uf": "string", "ufs": "array<string>", "autor": "string",
    "partido": "string", "funcao": "string", "subfuncao": "string", "tipo_emenda": "string",
}
#: Columns that are asked for by a text which they hold, with the filter that gives it.
TEXT_COLUMNS = {"nome_autor": "autor", "tipo_emenda": "tipo_emenda"}
KEY_COLUMNS = ["ano", "uf", "partido", "funcao", "subfuncao", "nome_autor", "tipo_emenda"]
SHORTEST_QUESTION, LONGEST_QUESTION = 3, 500


def valid_questions(questions: DataFrame) -> DataFrame:
    """All questions, with ``valida``: whether the length is an accepted one; a null question is not valid."""
    return questions.withColumn("valida", F.coalesce(F.length("consulta").between(SHORTEST_QUESTION, LONGEST_QUESTION), F.lit(False)))


def parse_entities(replies: DataFrame) -> DataFrame:
    """(id_consulta, consulta, resposta) -> entidades map.

    The JSON object is taken from a fenced block when there is one, else from
    the text.  It is read as a one-element list, so that text after it is an
    error; anything that is no single JSON object gives {"raw_query": consulta}.
    """
    fenced = r"(?s)```(?:json)?\s*(.*?)\s*```"
    reply = F.col("resposta")
    body = F.when(reply.rlike(fenced), F.regexp_extract(reply, fenced, 1)).otherwise(reply)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    listed = F.concat(F.lit("["), found, F.lit("]"))
    objects = F.from_json(listed, "array<map<string,string>>", {"allowSingleQuotes": "false"})
    entities = F.when((found != "") & (F.size(objects) == 1), objects[0])
    failure = F.create_map(F.lit("raw_query"), F.col("consulta"))
    return replies.withColumn("entidades", F.coalesce(entities, failure))


def question_dictionary(legislators: DataFrame) -> DataFrame:
    """(termo, campo, valor): every term a question may name.

    The fixed terms come along with the parties and names of ``legislators``.
    Terms are unique per field, so a word never matches twice.
    """
    spark = legislators.sparkSession
    areas = dict.fromkeys([*SUBFUNCTION_TERMS, *FUNCTION_TERMS])
    fixed = (
        [(term, "area", term) for term in areas]
        + [(name, "uf", name) for name in REGION_STATES]
        + [(name.lower(), "uf", code) for name, code in STATE_CODES.items()]
        + [(term, "tipo_emenda", kind) for term, kind in AMENDMENT_TYPE_TERMS.items()]
        + [(term, "operacao", name) for term, name in OPERATION_TERMS.items()]
    )
    terms = spark.createDataFrame(fixed, "termo string, campo string, valor string")
    people = [
        legislators.filter(F.col(c) != "").select(
            F.lower(c).alias("termo"), F.lit(field).alias("campo"), F.col(c).alias("valor")
        )
        for c, field in (("partido", "partido"), ("nome", "autor"))
    ]
    everything = reduce(DataFrame.unionByName, people, terms)
    return everything.groupBy("termo", "campo").agg(F.min("valor").alias("valor"))


def _words(column: str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def extract_entities(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(id_consulta, consulta) -> one column per entity, by dictionary matching.

    The first word of a term decides which word sequences of a question are
    looked up at all; those meet the dictionary in an equi-join.  Words are ruled
    out alone, and only the sequences that are left are cut from their question.  Per field the
    match with most words wins, then the longest, then the earliest.  One year gives ``ano``, several give
    ``ano_inicio`` and ``ano_fim``.
    """
    terms = terms.withColumn("_partes", _words("termo")).filter(F.size("_partes") > 0)
    terms = terms.select(F.array_join("_partes", " ").alias("termo"), "campo", "valor", F.col("_partes")[0].alias("_inicio"), F.size("_partes").alias("n"))
    openings = terms.groupBy("_inicio").agg(F.collect_set("n").alias("_tamanhos"))
    words = questions.select("id_consulta", _words("consulta").alias("_palavras"))
    starts = words.select("id_consulta", F.posexplode("_palavras").alias("i", "_inicio")).join(openings, "_inicio").select("id_consulta", "i", "_tamanhos")
    found = starts.groupBy("id_consulta").agg(F.collect_list(F.struct("i", "_tamanhos")).alias("_onde"))
    sized = words.join(found, "id_consulta").select("id_consulta", "_palavras", F.explode("_onde").alias("_lugar"))
    sized = sized.select("id_consulta", "_palavras", F.col("_lugar.i").alias("i"), F.explode("_lugar._tamanhos").alias("n")).filter(F.col("i") + F.col("n") <= F.size("_palavras"))
    grams = sized.select("id_consulta", "i", F.array_join(F.slice("_palavras", F.col("i") + 1, F.col("n")), " ").alias("termo"))
    matched = grams.join(terms.select("termo", "campo", "valor", "n"), "termo")
    fields = ["autor", "partido", "uf", "area", "tipo_emenda", "operacao"]
    best = F.struct(F.col("n"), F.length("termo"), -F.col("i"))
    chosen = matched.groupBy("id_consulta").agg(
        *[F.max_by(F.when(F.col("campo") == f, F.col("valor")), F.when(F.col("campo") == f, best)).alias(f) for f in fields]
    )
    years = F.array_sort(
        F.transform(F.regexp_extract_all("consulta", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    )
    first, last = F.array_min(years), F.array_max(years)
    several = F.size(years) > 1
    dated = questions.withColumns(
        {
            "ano": F.when(~several, first),
            "ano_inicio": F.when(several, first),
            "ano_fim": F.when(several, last),
        }
    )
    return dated.join(chosen, "id_consulta", "left")


def entity_map(extracted: DataFrame) -> DataFrame:
    """The entity columns as one map, absent ones left out."""
    fields = ["autor", "partido", "uf", "ano", "ano_inicio", "ano_fim", "area", "tipo_emenda", "operacao"]
    entries = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("valor")) for f in fields])
    return extracted.withColumn("entidades", F.map_from_entries(F.filter(entries, lambda e: e["valor"].isNotNull())))


def _entity(name: str) -> Column:
    value = F.try_element_at("entidades", F.lit(name))
    return F.when(value != "", value)


def _year(name: str) -> Column:
    year = _entity(name).try_cast("int")
    return F.when(year != 0, year)


def unresolved_areas(questions: DataFrame) -> DataFrame:
    """Distinct area terms the dictionary does not know; only these need vectors."""
    area = strip(F.lower(_entity("area")))
    return questions.select(area.alias("area")).filter(dictionary.resolve_area(F.col("area")).isNull() & F.col("area").isNotNull()).distinct()


def decompose(questions: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """(id_consulta, entidades) -> typed filters, ``termo_vetorial`` and ``operacao``.

    An area is looked up in the dictionary, then in ``nearest`` (area, funcao),
    the similarity result for the unresolved ones; what is still unresolved
    becomes the term of a vector search.
    """
    start, end = _year("ano_inicio"), _year("ano_fim")
    both = start.isNotNull() & end.isNotNull()
    region, area = dictionary.resolve_region(_entity("uf")), strip(F.lower(_entity("area")))
    code = dictionary.resolve_area(area)
    typed = questions.withColumns(
        {
            "ano": _year("ano"),
            "ano_inicio": F.when(both, start),
            "ano_fim": F.when(both, end),
            "uf": F.when(region.isNull(), F.element_at(dictionary.resolve_uf(_entity("uf")), 1)),
            "ufs": region,
            "autor": F.upper(_entity("autor")),
            "partido": F.upper(_entity("partido")),
            "tipo_emenda": _entity("tipo_emenda"),
            "funcao": F.when(F.length(code) <= 2, code),
            "subfuncao": F.when(F.length(code) > 2, code),
            "_area": F.when(code.isNull(), area),
            "operacao": F.coalesce(F.try_element_at("entidades", F.lit("operacao")), F.lit("busca")),
        }
    )
    if nearest is not None:
        similar = nearest.filter(F.col("funcao").isNotNull()).select(F.col("area").alias("_area"), F.col("funcao").alias("_codigo"))
        typed = typed.join(similar, "_area", "left")
        typed = typed.withColumn("funcao", F.coalesce("funcao", "_codigo"))
        term = F.when(F.col("_codigo").isNull(), F.col("_area"))
    else:
        term = F.col("_area")
    return typed.withColumn("termo_vetorial", term).select("id_consulta", *FILTER_SCHEMA, "termo_vetorial", "operacao")


def filter_sets(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id_consulta, _filtro) of every question, and the distinct filter sets under a number of their own.

    However often a question is asked, its filters are answered once.  The sets
    are written out, which makes their numbers final.
    """
    missing = {c: F.lit(None).cast(t) for c, t in FILTER_SCHEMA.items() if c not in questions.columns}
    named = questions.withColumns(missing).withColumn("_filtro", F.to_json(F.struct(*FILTER_SCHEMA)))
    sets = named.select("_filtro", *FILTER_SCHEMA).dropDuplicates(["_filtro"])
    return named.select("id_consulta", "_filtro"), written(sets.withColumn("_numero", F.monotonically_increasing_id()), "filtros")


def _contains(text: Column, part: Column) -> Column:
    """ILIKE '%part%' with a per-row pattern; only texts with wildcards pay for the pattern match."""
    wild = part.rlike(r"[%_\\]")
    pattern = F.concat(F.lit("%"), part, F.lit("%"))
    return F.when(wild, F.ilike(text, pattern)).otherwise(F.contains(F.lower(text), F.lower(part)))


def _values_holding(sets: DataFrame, field: str, rows: DataFrame, column: str) -> DataFrame:
    """(field, _q_column): the distinct values of a column that hold the text a filter set asks for.

    Values meet the longest plain part of a text in an equi-join, as their pieces of the lengths that occur.
    """
    plain = F.transform(F.split(F.lower(field), r"[%_\\]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("parte")))
    texts = sets.select(field).dropna().distinct().select(F.col(field).alias("_pedido"), F.array_max(plain)["parte"].alias("_parte"))
    lengths = texts.select(F.length("_parte").alias("_tamanho")).distinct()
    lowered = rows.select(column).dropna().distinct().withColumn("_texto", F.lower(column))
    sized = lowered.withColumn("_tamanho", F.explode(F.sequence(F.lit(0), F.length("_texto")))).join(lengths, "_tamanho", "left_semi")
    starts = F.sequence(F.lit(1), F.length("_texto") - F.col("_tamanho") + 1)
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_texto"), i, F.col("_tamanho"))))
    met = sized.select(column, F.explode(pieces).alias("_parte")).join(texts, "_parte")
    return met.filter(_contains(F.col(column), F.col("_pedido"))).select(F.col("_pedido").alias(field), F.col(column).alias(f"_q_{column}"))


def held_texts(sets: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(column, _textos_column): the values of a column that hold some text the filter sets ask for, with those texts."""
    field = TEXT_COLUMNS[column]
    held = _values_holding(sets, field, rows, column).groupBy(F.col(f"_q_{column}").alias(column))
    return held.agg(F.array_sort(F.collect_list(field)).alias(f"_textos_{column}"))


def with_texts(rows: DataFrame, sets: DataFrame, amendments: DataFrame, masks: Iterable[int]) -> DataFrame:
    """Rows with the texts that their author and type hold, as far as a group of keys asks for one."""
    for column in TEXT_COLUMNS:
        if any(mask >> KEY_COLUMNS.index(column) & 1 for mask in masks):
            rows = rows.join(held_texts(sets, amendments, column), column, "left")
    return rows


def lookups(mask: int, key: Callable[[dict[str, Column]], Column]) -> Column:
    """The keys that a row looks up for one group: ``key`` for each choice of the texts it holds; without texts in the group, one."""

    def choose(columns: list[str], texts: dict[str, Column]) -> Column:
        if not columns:
            return F.array(key(texts))
        held = F.coalesce(F.col(f"_textos_{columns[0]}"), F.array().cast("array<string>"))
        return F.flatten(F.transform(held, lambda text: choose(columns[1:], texts | {columns[0]: text})))

    return choose([c for c in TEXT_COLUMNS if mask >> KEY_COLUMNS.index(c) & 1], {})


def years_within(amendments: DataFrame) -> Column:
    """The years between ``ano_inicio`` and ``ano_fim`` that occur."""
    occurring = [row["ano"] for row in amendments.select("ano").dropna().distinct().collect()]  # calendar years
    return F.filter(F.array(*map(F.lit, occurring)).cast("array<int>"), lambda y: y.between(F.col("ano_inicio"), F.col("ano_fim")))


def search_keys(sets: DataFrame, amendments: DataFrame) -> DataFrame:
    """One row per filter set and combination of key values; null keys filter nothing.

    A text is a key itself, which rows look up with the texts they hold: naming all values
    that hold it would make a row for each of them and each set.  A range of years becomes
    the years that occur, a list of states its states; both stay conditions beside a year or
    state of the set's own.
    """
    any_year, any_state = F.array(F.lit(None).cast("int")), F.array(F.lit(None).cast("string"))
    tests = rest_tests()
    years = F.when(F.col("ano").isNotNull(), F.array("ano")).when(tests["periodo"], years_within(amendments)).otherwise(any_year)
    states = F.when(F.col("uf").isNotNull(), F.array("uf")).when(tests["estados"], F.array_distinct(F.array_compact("ufs"))).otherwise(any_state)
    one = sets.withColumn("_q_ano", F.explode(years)).withColumn("_q_uf", F.explode(states))
    named = one.withColumns({f"_q_{c}": F.col(c) for c in ("partido", "funcao", "subfuncao")} | {f"_q_{c}": F.col(field) for c, field in TEXT_COLUMNS.items()})
    rest = [F.when(F.col("ano").isNotNull(), F.col(c)).alias(c) for c in ("ano_inicio", "ano_fim")] + [F.when(F.col("uf").isNotNull(), F.col("ufs")).alias("ufs")]
    carried = [F.when(F.col(f"_q_{c}").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(KEY_COLUMNS)]
    mask = reduce(lambda a, b: a + b, carried).alias("_mascara")
    return named.select("_numero", *[f"_q_{c}" for c in KEY_COLUMNS], *rest, mask)


def rest_tests() -> dict[str, Column]:
    """Which conditions beyond its keys a filter set carries."""
    return {
        "periodo": F.col("ano_inicio").isNotNull() & F.col("ano_fim").isNotNull(),
        "estados": F.size("ufs") > 0,
    }


def _rest_checks() -> dict[str, Column]:
    """Those conditions on an amendment; a set without the condition passes."""
    tests = rest_tests()
    holds = {
        "periodo": F.col("_ano").between(F.col("ano_inicio"), F.col("ano_fim")),
        "estados": F.array_contains("ufs", F.col("_uf")),
    }
    return {name: ~F.coalesce(tests[name], F.lit(False)) | holds[name] for name in holds}


def structured_ranks(questions: DataFrame, amendments: DataFrame, legislators: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """(id_consulta, id, posicao): the k largest amendments of every question, in one scan.

    A filter a question does not carry must match everything, which as a plain
    join condition would pair all questions with all rows.  Instead the distinct
    filter sets are grouped by *which* keys they carry; every amendment looks up
    one key per such group, so the join stays an equi-join.  Sets that filter
    nothing share one plain top-k.  Only the number, id and amount of matching
    pairs move, cut to k per filter set before the shuffle.
    """
    asked, sets = filter_sets(questions)
    keys = written(search_keys(sets, amendments), "chaves")
    carried = {name: F.count_if(test).alias(name) for name, test in rest_tests().items()}
    groups = keys.groupBy("_mascara").agg(*carried.values()).collect()  # at most 2**7 rows
    masks = sorted(row["_mascara"] for row in groups if row["_mascara"])
    used = [c for i, c in enumerate(KEY_COLUMNS) if any(m >> i & 1 for m in masks)]
    checks = [check for name, check in _rest_checks().items() if any(row[name] for row in groups)]

    largest = amendments.select("id", "valor_empenhado").orderBy(F.col("valor_empenhado").desc_nulls_last(), "id").limit(k)
    listed = largest.agg(F.collect_list(F.struct("id", "valor_empenhado"))).scalar()
    unfiltered = keys.filter("_mascara = 0").select("_numero", listed.alias("_maiores"))
    matched = unfiltered.select("_numero", F.inline("_maiores"))
    if masks:
        facts = with_party(amendments, legislators) if "partido" in used else amendments

        def key(mask: int) -> Callable[[dict[str, Column]], Column]:
            def field(c: str, texts: dict[str, Column]) -> Column:
                value = texts.get(c, F.col(c))
                return (value if mask >> KEY_COLUMNS.index(c) & 1 else F.lit(None).cast(facts.schema[c].dataType)).alias(c)

            return lambda texts: F.struct(F.lit(mask).alias("mascara"), *[field(c, texts) for c in used])

        probe = with_texts(facts, sets, amendments, masks).select(
            "id", "valor_empenhado", F.col("ano").alias("_ano"), F.col("uf").alias("_uf"), F.explode(F.concat(*[lookups(mask, key(mask)) for mask in masks])).alias("_chave")
        )
        same = reduce(
            lambda a, b: a & b,
            [F.col(f"_chave.{c}").eqNullSafe(F.col(f"_q_{c}")) for c in used],
            F.col("_chave.mascara") == F.col("_mascara"),
        )
        met = probe.join(join_side(keys), reduce(lambda a, b: a & b, checks, same))
        matched = matched.unionByName(met.select("_numero", "id", "valor_empenhado"))
    order = Window.partitionBy("_numero").orderBy(F.col("valor_empenhado").desc_nulls_last(), F.asc("id"))
    best = matched.withColumn("posicao", F.row_number().over(order)).filter(F.col("posicao") <= k)
    named = sets.select("_numero", "_filtro").join(best.select("_numero", "id", "posicao"), "_numero")
    return asked.join(named, "_filtro").select("id_consulta", "id", "posicao")


def answer_many(questions: DataFrame, amendments: DataFrame, legislators: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """The ranked rows of every question with their attributes and party."""
    ranked = written(structured_ranks(questions, amendments, legislators, k), "posicoes")
    return with_party(amendments.join(ranked, "id"), legislators)


def answer_summary(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Mode and number of results per question; questions without rows count 0."""
    found = answers.groupBy("id_consulta").agg(F.count("*").alias("_linhas"))
    mode = F.when(F.col("termo_vetorial").isNotNull(), F.lit("hibrido")).otherwise(F.lit("sql"))
    return questions.join(found, "id_consulta", "left").select(
        "id_consulta", mode.alias("modo"), F.coalesce("_linhas", F.lit(0)).cast("int").alias("num_resultados")
    )


YEAR_FIELDS = ["ano", "ano_inicio", "ano_fim"]


def verify_entities(results: DataFrame) -> DataFrame:
    """Score the map ``entidades`` against the map ``esperado``, row by row.

    Years must be equal as text; any other expected text must be contained in
    the extracted one, ignoring case.  A missing field is a miss.
    """

    def hit(expected: Column) -> Column:
        got, want = F.try_element_at("entidades", expected["key"]), expected["value"]
        equal = F.when(expected["key"].isin(YEAR_FIELDS), got == want).otherwise(F.contains(F.lower(got), F.lower(want)))
        return F.coalesce(equal, F.lit(False))

    hits = F.size(F.filter(F.map_entries("esperado"), hit))
    total = F.size("esperado")
    share = F.when(total > 0, F.round(hits / total, 4)).otherwise(F.lit(0.0))
    return results.withColumns({"acertos": hits, "total": total, "precisao_entidades": share})
