"""The figure that each question of a table asks for: totals, means, rankings, counts, comparisons, trends, growth, ratios, lists.

Filter sets look up sums, not rows.  The facts are first summed for each combination of the
keys and details that some question needs; those cells are summed again for every group of keys that some filter set carries,
together with the detail its operation needs (a dimension, a year), before they meet the
filter sets in one equi-join.  What moves grows with the combinations that occur, not with
the facts, and a filter set without any filter is one more group of keys.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from erario.functions.fixed_values import RESULT_LIMIT
from erario.operators.filters import with_party
from erario.operators.questions import FILTER_SCHEMA, KEY_COLUMNS, TEXT_COLUMNS, filter_sets, held_texts, lookups, rest_tests, search_keys, with_texts, years_within
from erario.sources.writers import join_side, written

DIMENSIONS = {"autor": "nome_autor", "partido": "partido", "uf": "uf", "funcao": "funcao", "subfuncao": "subfuncao", "tipo_emenda": "tipo_emenda"}
#: What an operation groups by unless the question names a dimension; the others have one figure, or one for each year.
GROUPED_BY = {"ranking": "autor", "contagem_distinta": "autor", "lista": "autor", "comparacao": "tipo_emenda", "crescimento": "funcao"}
BY_YEAR = ("comparacao", "tendencia", "crescimento")
OPERATIONS = ("total", "media", "proporcao", "tendencia", *GROUPED_BY)
TOTAL = "decimal(38,2)"
FIGURE = "id_consulta, operacao, dimensao, grupo, ano, valor, pago, qtd, variacao, posicao"


def _cells(amendments: DataFrame, legislators: DataFrame, groups: list[Row]) -> DataFrame:
    """Sums for each combination of the keys and details that some group looks up; other columns are not grouped by."""
    used = {c for g in groups for i, c in enumerate(KEY_COLUMNS) if g["_mascara"] >> i & 1} | {DIMENSIONS[g["dimensao"]] for g in groups if g["dimensao"]}
    used |= {"ano" for g in groups if g["_por_ano"] or g["periodo"]} | {"uf" for g in groups if g["estados"]}
    paid = F.col("valor_pago") if "valor_pago" in amendments.columns else F.lit(0).cast("decimal(15,2)")
    rows = with_party(amendments, legislators) if "partido" in used else amendments
    sums = rows.groupBy(*[c for c in KEY_COLUMNS if c in used]).agg(F.sum("valor_empenhado").cast(TOTAL).alias("valor"), F.sum(paid).cast(TOTAL).alias("pago"), F.count("valor_empenhado").alias("qtd"))
    kinds = {c: (legislators if c == "partido" else amendments).schema[c].dataType for c in KEY_COLUMNS}
    return sums.withColumns({c: F.lit(None).cast(kinds[c]) for c in KEY_COLUMNS if c not in used})


def _plans(questions: DataFrame) -> DataFrame:
    """(id_consulta, operacao, dimensao) of the questions that ask for a figure; an unknown dimension is the operation's own."""
    asked = F.col("operacao")
    own = F.coalesce(*[F.when(asked == name, F.lit(dimension)) for name, dimension in GROUPED_BY.items()])
    named = F.when(F.col("dimensao").isin(*DIMENSIONS), F.col("dimensao")) if "dimensao" in questions.columns else F.lit(None).cast("string")
    dimension = F.when(asked.isin(*GROUPED_BY), F.coalesce(named, own))
    return questions.filter(asked.isin(*OPERATIONS)).select("id_consulta", "operacao", dimension.alias("dimensao"))


def _lookup(cells: DataFrame, mask: int, dimension: str | None, by_year: bool, period: bool, states: bool) -> Column:
    """One group of keys with the detail of an operation, as keys that cells are summed by."""

    def only(column: str, wanted: bool, texts: dict[str, Column] = {}) -> Column:
        return F.when(F.lit(wanted), texts.get(column, F.col(column)).cast(cells.schema[column].dataType))

    def key(texts: dict[str, Column]) -> Column:
        keys = [only(c, bool(mask >> i & 1), texts).alias(f"_c_{c}") for i, c in enumerate(KEY_COLUMNS)]
        group = F.col(DIMENSIONS[dimension]).cast("string") if dimension else F.lit(None).cast("string")
        return F.struct(
            F.lit(mask).alias("_c_mascara"), F.lit(dimension or "").alias("_c_dimensao"), F.lit(by_year).alias("_c_por_ano"), *keys,
            group.alias("grupo"), only("ano", by_year).alias("ano"), only("ano", period).alias("_ano"), only("uf", states).alias("_uf"),
        )

    return lookups(mask, key)


def _sums(plans: DataFrame, sets: DataFrame, amendments: DataFrame, legislators: DataFrame) -> DataFrame:
    """(_numero, operacao, dimensao, grupo, ano, valor, pago, qtd): the summed cells of every filter set and operation."""
    keys = search_keys(sets, amendments)
    by_year = F.col("operacao").isin(*BY_YEAR)
    wanted = plans.select("_numero", "operacao", "dimensao").distinct()
    asked = written(keys.join(wanted, "_numero").withColumns({"_por_ano": by_year, "_dimensao": F.coalesce("dimensao", F.lit(""))}), "chaves")
    carried = {name: F.bool_or(F.coalesce(test, F.lit(False))).alias(name) for name, test in rest_tests().items()}
    groups = asked.groupBy("_mascara", "dimensao", "_por_ano").agg(*carried.values()).collect()  # key groups times dimensions, at most some hundred rows
    if not groups:
        return asked.select("_numero", "operacao", "dimensao", F.lit(None).cast("string").alias("grupo"), F.lit(None).cast("int").alias("ano"), *[F.lit(None).cast(TOTAL).alias(c) for c in ("valor", "pago")], F.lit(0).cast("long").alias("qtd"))
    cells = written(with_texts(_cells(amendments, legislators, groups), sets, amendments, [g["_mascara"] for g in groups]), "celulas")
    looked_up = [_lookup(cells, g["_mascara"], g["dimensao"], g["_por_ano"], g["periodo"], g["estados"]) for g in groups]
    added = [F.sum(c).cast(TOTAL).alias(c) for c in ("valor", "pago")] + [F.sum("qtd").alias("qtd")]
    summed = cells.withColumn("_chave", F.explode(F.concat(*looked_up))).select("_chave.*", "valor", "pago", "qtd")
    summed = summed.groupBy(*[c for c in summed.columns if c not in ("valor", "pago", "qtd")]).agg(*added)
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"_c_{c}").eqNullSafe(F.col(f"_q_{c}")) for c in KEY_COLUMNS],
        (F.col("_c_mascara") == F.col("_mascara")) & (F.col("_c_dimensao") == F.col("_dimensao")) & (F.col("_c_por_ano") == F.col("_por_ano")),
    )
    tests = rest_tests()
    within = ~F.coalesce(tests["periodo"], F.lit(False)) | F.col("_ano").between(F.col("ano_inicio"), F.col("ano_fim"))
    among = ~F.coalesce(tests["estados"], F.lit(False)) | F.array_contains("ufs", F.col("_uf"))
    met = summed.join(join_side(asked), same & within & among)
    return met.groupBy("_numero", "operacao", "dimensao", "grupo", "ano").agg(*added)


def figures(questions: DataFrame, amendments: DataFrame, legislators: DataFrame, n: int = RESULT_LIMIT) -> DataFrame:
    """The figures of every question: id_consulta, operacao, dimensao, grupo, ano, valor, pago, qtd, variacao, posicao.

    ``questions``: id_consulta, filters, ``operacao`` and optionally ``dimensao``; those of
    other operations, as a plain search, have no figure.  One row for ``total`` (of no rows:
    0), ``media``, ``proporcao`` (paid over committed) and ``contagem_distinta``; one for each
    of the ``n`` largest groups of a ``ranking``, for each year of a ``tendencia`` with its
    change, for each group and year of a ``comparacao``, for each group of a ``crescimento``
    between ``ano_inicio`` and ``ano_fim``, largest first, and for each name of a ``lista``.
    """
    asked, sets = filter_sets(questions)
    plans = written(_plans(questions).join(asked, "id_consulta").join(sets.select("_numero", "_filtro", "ano_inicio", "ano_fim"), "_filtro"), "planos")
    sums = written(_sums(plans, sets, amendments, legislators), "somas")
    shape = ["_numero", "operacao", "dimensao", "grupo", "ano", "valor", "pago", "qtd", "variacao", "posicao"]
    empty = {"grupo": F.lit(None).cast("string"), "ano": F.lit(None).cast("int"), "variacao": F.lit(None).cast("double"), "posicao": F.lit(None).cast("int")}

    def of(*operations: str) -> DataFrame:
        return sums.filter(F.col("operacao").isin(*operations))

    one = plans.filter(F.col("operacao").isin("total", "media", "proporcao")).select("_numero", "operacao", "dimensao").distinct()
    found = one.join(of("total", "media", "proporcao").select("_numero", "operacao", "valor", "pago", "qtd"), ["_numero", "operacao"], "left")
    count, none = F.coalesce("qtd", F.lit(0)), F.lit(0).cast(TOTAL)
    mean = F.round(F.col("valor") / F.nullif("qtd", F.lit(0)), 2)
    ratio = F.round(F.col("pago").cast("double") / F.nullif(F.col("valor").cast("double"), F.lit(0.0)), 6)
    single = found.select(
        "_numero", "operacao", "dimensao", F.when(F.col("operacao") == "media", mean).otherwise(F.coalesce("valor", none)).cast(TOTAL).alias("valor"), F.coalesce("pago", none).alias("pago"), count.alias("qtd"),
        F.when(F.col("operacao") == "proporcao", ratio).alias("variacao"), *[empty[c].alias(c) for c in ("grupo", "ano", "posicao")],
    )
    distinct = plans.filter("operacao = 'contagem_distinta'").select("_numero", "operacao", "dimensao").distinct()
    names = of("contagem_distinta").groupBy("_numero", "dimensao").agg(F.count("grupo").alias("qtd"), F.sum("valor").cast(TOTAL).alias("valor"), F.sum("pago").cast(TOTAL).alias("pago"))
    distinct = distinct.join(names, ["_numero", "dimensao"], "left").select("_numero", "operacao", "dimensao", F.coalesce("valor", none).alias("valor"), F.coalesce("pago", none).alias("pago"), count.alias("qtd"), *[c.alias(k) for k, c in empty.items()])

    set_of = ["_numero", "dimensao"]
    place = F.row_number().over(Window.partitionBy(*set_of).orderBy(F.desc("valor"), F.asc_nulls_last("grupo")))
    ranking = of("ranking").withColumn("posicao", place).filter(F.col("posicao") <= n).withColumn("variacao", empty["variacao"])
    before = F.lag("valor").over(Window.partitionBy("_numero").orderBy("ano"))
    trend = of("tendencia").withColumn("variacao", (F.col("valor") - before).cast("double")).withColumn("posicao", empty["posicao"])
    plain = of("comparacao", "lista").withColumn("variacao", empty["variacao"]).withColumn("posicao", empty["posicao"])
    span = plans.filter("operacao = 'crescimento'").select("_numero", "ano_inicio", "ano_fim").distinct()
    ends = of("crescimento").join(span, "_numero").filter(F.col("ano").isin(F.col("ano_inicio"), F.col("ano_fim")))
    at = lambda year: F.coalesce(F.sum(F.when(F.col("ano") == F.col(year), F.col("valor"))), none)
    growth = ends.groupBy("_numero", "operacao", "dimensao", "grupo").agg(
        F.max("ano_fim").alias("ano"), at("ano_fim").cast(TOTAL).alias("valor"), F.sum("pago").cast(TOTAL).alias("pago"), F.sum("qtd").alias("qtd"), (at("ano_fim") - at("ano_inicio")).cast("double").alias("variacao")
    )
    growth = growth.withColumn("posicao", F.row_number().over(Window.partitionBy(*set_of).orderBy(F.desc("variacao"), F.asc_nulls_last("grupo"))))
    everything = reduce(DataFrame.unionByName, [part.select(*shape) for part in (single, distinct, ranking, trend, plain, growth)])
    by_set = plans.select("id_consulta", "_numero", F.col("operacao").alias("_operacao"), F.col("dimensao").alias("_dimensao"))
    same = [by_set["_numero"] == everything["_numero"], F.col("_operacao") == F.col("operacao"), F.col("_dimensao").eqNullSafe(F.col("dimensao"))]
    return by_set.join(everything, reduce(lambda a, b: a & b, same)).select(*FIGURE.split(", "))


def _words(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, _palavra, _bits): the filter sets of each value as bits of 64-bit words."""
    return pairs.groupBy(*by, F.floor(F.col("filtro") / 64).cast("int").alias("_palavra")).agg(F.bit_or(F.expr("shiftleft(1L, cast(filtro % 64 as int))")).alias("_bits"))


def _bit_sets(sets: DataFrame, amendments: DataFrame) -> dict[str, tuple[str, DataFrame, Column]]:
    """For each condition: the column it tests, (column, _palavra, _bits) of the sets whose condition a value meets, and which sets lack the condition."""
    tests = {name: F.coalesce(test, F.lit(False)) for name, test in rest_tests().items()}
    states = F.explode(F.array_distinct(F.array_compact("ufs"))).alias("uf")
    found = {c: (c, _words(sets.filter(F.col(c).isNotNull()), c), F.col(c).isNull()) for c in ("ano", "uf", "partido", "funcao", "subfuncao")}
    found["periodo"] = ("ano", _words(sets.filter(tests["periodo"]).select("filtro", F.explode(years_within(amendments)).alias("ano")), "ano"), ~tests["periodo"])
    found["estados"] = ("uf", _words(sets.filter(tests["estados"]).select("filtro", states), "uf"), ~tests["estados"])
    for column, field in TEXT_COLUMNS.items():
        values = held_texts(sets, amendments, column).select(column, F.explode(f"_textos_{column}").alias("_texto"))
        of_text = _words(sets.filter(F.col(field).isNotNull()).withColumn("_texto", F.col(field)), "_texto")
        found[f"texto_{column}"] = (column, values.join(of_text, "_texto").groupBy(column, "_palavra").agg(F.bit_or("_bits").alias("_bits")), F.col(field).isNull())
    return found


def passed_filters(questions: DataFrame, amendments: DataFrame, legislators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id_consulta, filtro), (id, filtros)): the number of each question's filter set, and the bit set of those that an amendment passes.

    Each condition gives every value of its column the bit set of the sets which that value
    meets or which lack the condition; an amendment passes the sets in all of its values' bit
    sets, arrays of 64-bit words.  No row pairs a set with an amendment or an author.
    Amendments that pass none are left out.
    """
    asked, sets = filter_sets(questions)
    part = F.shiftright("_numero", 33)
    parts = sets.groupBy(part.alias("_parte")).agg(F.min("_numero").alias("_primeiro"), F.count("*").alias("n"))  # a row for each task that wrote sets
    before = F.sum("n").over(Window.orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_parte", (F.coalesce(before, F.lit(0)) - F.col("_primeiro")).alias("_salto"))
    numbers = written(sets.withColumn("_parte", part).join(starts, "_parte").select("_filtro", *FILTER_SCHEMA, (F.col("_numero") + F.col("_salto")).alias("filtro")), "numeros")
    numbered = asked.join(join_side(numbers.select("_filtro", "filtro")), "_filtro").select("id_consulta", "filtro")
    bit_sets = _bit_sets(numbers, amendments)
    counts = numbers.agg(F.count("*").alias("n"), *[F.count_if(~lacking).alias(name) for name, (_, _, lacking) in bit_sets.items()]).first()
    if not counts["n"]:
        return numbered, amendments.limit(0).select("id", F.array().cast("array<long>").alias("filtros"))
    bit_sets = {name: found for name, found in bit_sets.items() if counts[name]}
    bit = F.expr("shiftleft(1L, cast(filtro % 64 as int))")
    lacking = [F.bit_or(F.when(test, bit).otherwise(F.lit(0).cast("long"))).alias(name) for name, (_, _, test) in bit_sets.items()]
    free = written(numbers.groupBy(F.floor(F.col("filtro") / 64).cast("int").alias("_palavra")).agg(F.bit_or(bit).alias("_todos"), *lacking), "livres")  # a row for 64 sets

    def free_words(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("_palavra", F.col(name).alias("_bits"))))
        return free.agg(F.transform(ordered, lambda w: w["_bits"])).scalar()

    rows = with_party(amendments, legislators) if "partido" in bit_sets else amendments
    own = [c for c in ("partido", "nome_autor", "tipo_emenda", "ano", "uf", "funcao", "subfuncao") if c in {column for column, _, _ in bit_sets.values()}]
    passed, kept = rows.select("id", *own), ["id", *own]
    for name, (column, words, _) in sorted(bit_sets.items(), key=lambda item: own.index(item[1][0])):
        without = free_words(name)
        by_word = words.groupBy(F.col(column).alias(f"_{column}")).agg(F.map_from_entries(F.collect_list(F.struct("_palavra", "_bits"))).alias("_bits"))
        met = by_word.withColumn("_livres", without).select(f"_{column}", F.transform("_livres", lambda free_bits, i: free_bits.bitwiseOR(F.coalesce(F.try_element_at("_bits", i), F.lit(0).cast("long")))).alias("_encontrados"))
        both = F.zip_with("filtros", "_bits", lambda a, b: a.bitwiseAND(b)) if "filtros" in kept else F.col("_bits")
        kept = list(dict.fromkeys([*kept, "filtros"]))
        passed = passed.join(met, F.col(column) == F.col(f"_{column}"), "left").withColumn("_bits", F.coalesce("_encontrados", without)).withColumn("filtros", both).select(*kept)
    if not bit_sets:
        return numbered, passed.select("id", free_words("_todos").alias("filtros"))
    return numbered, passed.filter(F.exists("filtros", lambda w: w != 0)).select("id", "filtros")
