"""Registered queries: sources, sinks, normalisation, integrity."""

from pyspark.sql import Column, DataFrame, functions as F

from erario.functions import money, text
from erario.functions.fixed_values import STATE_CODES
from erario.operators import integrity, normalize
from erario.plans.registry import query
from erario.plans.views import Tables, on_views, plain_money
from erario.sources import readers, writers

# Names the stand-in records carry, so that the code rules have something to find.
FUNCTION_NAMES = ["Saúde", "EDUCAÇÃO BÁSICA", "Urbanismo", "Segurança pública e Transporte", "transporte"]
STATE_NAMES = list(STATE_CODES)
PAGE_ROWS = 1000
#: Ids of as many pages are gathered before they are cut into pages, so that pages of one folder are filled.
GATHERED_PAGES = 32


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _sql_pick(values: list[str], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({index}) + 1]"


def _brl_text(amount: Column) -> Column:
    return F.replace(money.format_brl(amount), F.lit("R$ "), F.lit(""))


def raw_amendments(t: Tables) -> DataFrame:
    """Amendments in the shape of the public API: names untidy, money as text or number."""
    priority = F.substring("funcao", 2, 1).cast("int")
    state = F.regexp_extract("uf", "([0-9]+)", 1).cast("int")
    even = F.col("id") % 2 == 0
    number = F.col("valor_empenhado").cast("string")
    paid = F.when(F.col("valor_pago") > 0, F.concat(F.lit('"'), _brl_text(F.col("valor_pago")), F.lit('"')))
    quoted = F.concat(F.lit('"'), _brl_text(F.col("valor_empenhado")), F.lit('"'))
    return t.amendments(paid=True).select(
        F.col("id"),
        F.when(F.col("id") % 10 == 9, F.lit("S/I")).otherwise(F.col("codigo_emenda")).alias("codigoEmenda"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("  "), F.lower("nome_autor"), F.lit(" "))).alias("nomeAutor"),
        F.col("nome_autor").alias("autor"),
        "ano",
        F.col("tipo_emenda").alias("tipoEmenda"),
        _pick(FUNCTION_NAMES, priority - 1).alias("funcao"),
        F.when(even, F.concat("subfuncao", F.lit(" - "), "subfuncao_nome")).otherwise(F.col("subfuncao_nome")).alias("subfuncao"),
        F.col("subfuncao_nome").alias("nomeSubfuncao"),
        F.concat(_pick(STATE_NAMES, state), F.when(F.col("id") % 3 == 0, F.lit(" (MUN)")).otherwise(F.lit(" (UF)"))).alias(
            "localidadeDoGasto"
        ),
        F.parse_json(F.when(even, number).otherwise(quoted)).alias("valorEmpenhado"),
        F.parse_json(paid).alias("valorPago"),
    )


NORMALIZED_SQL = f"""SELECT id, CASE WHEN id % 10 = 9 THEN 'S/I' ELSE codigo_emenda END AS codigo_emenda, nome_autor, ano, tipo_emenda,
    ([10, 12, NULL, 6, 26])[CAST(funcao AS INTEGER)] AS codigo, {_sql_pick(FUNCTION_NAMES, "CAST(funcao AS INTEGER) - 1")} AS funcao_nome,
    CASE WHEN id % 2 = 0 THEN subfuncao ELSE '' END AS subfuncao,
    CASE WHEN id % 2 = 0 THEN subfuncao || ' - ' || subfuncao_nome ELSE subfuncao_nome END AS subfuncao_nome,
    CASE WHEN id % 3 = 0 THEN '' ELSE {_sql_pick(list(STATE_CODES.values()), "CAST(regexp_extract(uf, '([0-9]+)', 1) AS INTEGER)")} END AS uf,
    valor_empenhado::DOUBLE AS valor_empenhado, valor_liquidado::DOUBLE AS valor_liquidado, valor_pago::DOUBLE AS valor_pago, subfuncao_nome AS descricao
    FROM amendments"""
NORMALIZED_COLUMNS = (
    "codigo_emenda, nome_autor, ano, tipo_emenda, coalesce(lpad(CAST(codigo AS VARCHAR), 2, '0'), '') AS funcao, "
    "funcao_nome, subfuncao, subfuncao_nome, uf, valor_empenhado, valor_liquidado, valor_pago, descricao"
)


def _shown(df: DataFrame) -> DataFrame:
    return plain_money(df.drop("localidade", "fonte"))


def land_amendments(t: Tables) -> str:
    """Land the raw records as JSON lines under ``ano=YYYY/``."""
    path = writers.scratch_path(t.spark, "paginas")
    records = raw_amendments(t)
    line = F.to_json(F.struct(*[c for c in records.columns if c not in ("id", "ano")]))
    records.select("ano", line.alias("value")).write.partitionBy("ano").text(path)
    return path


def land_arrays(records: DataFrame, path: str, folder_by: str | None = None) -> None:
    """Land records as files that each hold one JSON array of at most PAGE_ROWS records."""
    span = F.floor(F.col("id") / (PAGE_ROWS * GATHERED_PAGES))
    by = [span.alias("_faixa"), *([folder_by] if folder_by else [])]
    body = F.struct(*[c for c in records.columns if c not in ("id", folder_by)])
    gathered = records.groupBy(*by).agg(F.collect_list(body).alias("_registros"))
    starts = F.sequence(F.lit(1), F.size("_registros"), F.lit(PAGE_ROWS))
    cut = gathered.withColumn("_pagina", F.explode(F.transform(starts, lambda i: F.slice("_registros", i, PAGE_ROWS))))
    pages = cut.select(*([folder_by] if folder_by else []), F.to_json("_pagina").alias("value"))
    writer = pages.write.option("maxRecordsPerFile", 1)
    (writer.partitionBy(folder_by) if folder_by else writer).text(path)


@query("s1_read_amendments", on_views("amendments", f"SELECT {NORMALIZED_COLUMNS} FROM n", n=NORMALIZED_SQL))
def _(t):
    return _shown(normalize.normalize_amendments(readers.read_amendments(t.spark, land_amendments(t))))


@query("s1_read_amendments_of_years", on_views("amendments", f"SELECT {NORMALIZED_COLUMNS} FROM n WHERE ano IN (1996, 1999)", n=NORMALIZED_SQL))
def _(t):
    raw = readers.read_amendments(t.spark, land_amendments(t), [1996, 1999])
    return _shown(normalize.normalize_amendments(raw))


LEGISLATURES = 2


def land_legislators(t: Tables) -> str:
    """Land ``{"dados": [...]}`` pages of 100 legislators, one per line, under ``legislatura=N/``."""
    path = writers.scratch_path(t.spark, "deputados")
    record = F.struct(
        F.col("cod_autor").alias("id"),
        F.lower("nome").alias("nome"),
        F.col("partido").alias("siglaPartido"),
        F.col("uf").alias("siglaUf"),
        F.concat(F.lit("foto/"), "cod_autor").alias("urlFoto"),
    )
    number = (F.col("cod_autor") % LEGISLATURES + 56).alias("legislatura")
    pages = t.legislators.groupBy(number, F.floor(F.col("cod_autor") / 100).alias("pagina")).agg(F.collect_list(record).alias("dados"))
    pages.select("legislatura", F.to_json(F.struct("dados")).alias("value")).write.partitionBy("legislatura").text(path)
    return path


@query(
    "s2_read_legislators",
    on_views(
        "legislators",
        """SELECT cod_autor, nome, partido, uf, 'foto/' || cod_autor AS url_foto,
           CAST(cod_autor % 2 + 56 AS VARCHAR) AS legislaturas FROM legislators""",
    ),
)
def _(t):
    rows = normalize.normalize_legislators(readers.read_legislators(t.spark, land_legislators(t)))
    return rows.withColumn("legislaturas", F.array_join(F.col("legislaturas").cast("array<string>"), ","))


@query(
    "s3_read_legislator_details",
    on_views(
        "legislators",
        """SELECT cod_autor, nome, partido, CASE WHEN cod_autor % 3 = 0 THEN NULL ELSE lower(nome) || ' civil' END AS nome_civil,
           CASE WHEN cod_autor % 3 > 0 THEN '' END AS municipio_nascimento,
           CASE WHEN cod_autor % 3 > 0 THEN 'Superior' END AS escolaridade FROM legislators""",
    ),
)
def _(t):
    path = writers.scratch_path(t.spark, "detalhes")
    people = t.legislators.filter(F.col("cod_autor") % 3 > 0)
    body = F.struct(
        F.col("cod_autor").alias("id"), F.concat(F.lower("nome"), F.lit(" civil")).alias("nomeCivil"), F.lit("Superior").alias("escolaridade")
    )
    people.select(F.to_json(F.struct(body.alias("dados"))).alias("value")).write.text(path)
    joined = readers.with_details(t.legislators, readers.read_legislator_details(t.spark, path))
    return joined.select("cod_autor", "nome", "partido", "nome_civil", "municipio_nascimento", "escolaridade")


def land_classification(t: Tables) -> str:
    path = writers.scratch_path(t.spark, "classificacao")
    rows = t.classification.select(
        (F.col("id") % 28).cast("string").alias("CodFuncao"),
        F.col("funcao_nome").alias("Funcao"),
        F.col("subfuncao").alias("CodSubfuncao"),
        F.col("subfuncao_nome").alias("Subfuncao"),
        F.col("programa").alias("CodPrograma"),
        F.col("programa_nome").alias("Programa"),
    )
    rows.write.option("sep", ";").option("header", True).csv(path)
    return path


@query(
    "s4_read_classification",
    on_views(
        "classification",
        """SELECT lpad(CAST(id % 28 AS VARCHAR), 2, '0') AS funcao, funcao_nome, lpad(subfuncao, 3, '0') AS subfuncao, subfuncao_nome,
           programa, programa_nome, funcao_nome || ' - ' || subfuncao_nome || ' - ' || programa_nome AS descricao FROM classification""",
    ),
)
def _(t):
    return normalize.normalize_classification(readers.read_classification(t.spark, land_classification(t)))


@query("s5_read_json_array", on_views("amendments", f"SELECT {NORMALIZED_COLUMNS} FROM n", n=NORMALIZED_SQL))
def _(t):
    from erario import schemas

    path = writers.scratch_path(t.spark, "lista")
    land_arrays(raw_amendments(t), path)
    return _shown(normalize.normalize_amendments(readers.read_json_array(t.spark, path, schemas.RAW_AMENDMENTS)))


@query("s6_read_years", on_views("amendments", f"SELECT {NORMALIZED_COLUMNS} FROM n WHERE ano BETWEEN 1990 AND 1998", n=NORMALIZED_SQL))
def _(t):
    path = writers.scratch_path(t.spark, "anos")
    named = raw_amendments(t).withColumn("arquivo", F.concat(F.lit("emendas_"), "ano", F.lit(".json"))).drop("ano")
    land_arrays(named, path, "arquivo")
    return _shown(normalize.normalize_amendments(readers.read_years(t.spark, path, 1990, 1998)))


@query(
    "s7_read_vectors",
    on_views("vectors", "SELECT CAST(id AS VARCHAR) AS codigo, 'rotulo ' || label AS texto, len(embedding) AS dimensoes, round(list_sum(embedding), 5) AS soma FROM vectors"),
)
def _(t):
    path = writers.scratch_path(t.spark, "vetores")
    stored = t.vectors.select(F.col("id").cast("string").alias("codigo"), F.concat(F.lit("rotulo "), "label").alias("texto"), "embedding")
    stored.write.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return readers.read_vectors(t.spark, path).select(
        "codigo", "texto", F.size("embedding").cast("bigint").alias("dimensoes"), F.round(total, 5).alias("soma")
    )


@query(
    "s8_write_table",
    on_views(
        "amendments",
        """SELECT ano, count(*) AS qtd, sum(CASE WHEN ano = 1998 THEN 0 ELSE valor_empenhado END)::DOUBLE AS empenhado
           FROM amendments GROUP BY ano""",
    ),
)
def _(t):
    """Write by year, then replace one year's partition with zeroed amounts."""
    path = writers.scratch_path(t.spark, "emendas")
    rows = t.amendments(author=False)
    writers.write_table(rows, path)
    zeroed = rows.filter("ano = 1998").withColumn("valor_empenhado", F.lit(0).cast(money.AMOUNT))
    writers.replace_partitions(zeroed, path)
    stored = t.spark.read.schema(rows.schema).parquet(path)
    return plain_money(stored.groupBy("ano").agg(F.count("*").alias("qtd"), F.sum("valor_empenhado").alias("empenhado")))


@query(
    "s9_write_report",
    on_views("question_log", "SELECT modo_busca, count(*) AS n_execucoes, min(latencia_ms) AS min_ms, max(latencia_ms) AS max_ms FROM question_log GROUP BY 1"),
)
def _(t):
    from erario.operators.aggregates import latency_stats

    path = writers.scratch_path(t.spark, "relatorio")
    metrics = latency_stats(t.question_log, "modo_busca").select("modo_busca", "n_execucoes", "min_ms", "max_ms")
    writers.write_report(metrics, path)
    return t.spark.read.schema(metrics.schema).json(path)


@query("n1_normalize_amendments", on_views("amendments", f"SELECT id, {NORMALIZED_COLUMNS} FROM n", n=NORMALIZED_SQL))
def _(t):
    landed = writers.written(raw_amendments(t), "brutas")
    return _shown(normalize.normalize_amendments(landed, "id"))


@query(
    "n2_parse_brl",
    """SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(15,2))::DOUBLE AS valor,
       CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(15,2)) * 100 END::DOUBLE AS sem_ponto FROM orders""",
)
def _(t):
    amount = F.col("o_totalprice").cast(money.AMOUNT)
    unmarked = F.when(F.col("o_orderkey") % 5 > 0, amount.cast("string"))
    rows = t.table("orders").select(
        F.col("o_orderkey").alias("id"),
        money.parse_brl(_brl_text(amount)).alias("valor"),
        money.parse_brl(unmarked).alias("sem_ponto"),
    )
    return plain_money(rows)


@query(
    "n3_extract_uf",
    f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {_sql_pick(list(STATE_CODES.values()), "c_custkey % 27")} END AS uf FROM customer""",
)
def _(t):
    ending = F.when(F.col("c_custkey") % 3 == 0, F.lit(" (MUN)")).otherwise(F.lit(" (UF)"))
    place = F.concat(_pick(STATE_NAMES, F.col("c_custkey") % 27), ending)
    return t.table("customer").select(F.col("c_custkey").alias("id"), text.extract_uf(place).alias("uf"))


@query(
    "n4_function_code",
    """SELECT o_orderkey AS id, coalesce((['10', '12', '', '06', '26'])[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)], '') AS funcao FROM orders""",
)
def _(t):
    name = _pick(FUNCTION_NAMES, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return t.table("orders").select(F.col("o_orderkey").alias("id"), text.function_code(name).alias("funcao"))


@query("n5_subfunction_code", "SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 100 THEN substr(CAST(o_orderkey AS VARCHAR), 1, 3) ELSE '' END AS subfuncao FROM orders")
def _(t):
    label = F.concat(F.col("o_orderkey").cast("string"), F.lit(" - "), "o_orderpriority")
    return t.table("orders").select(F.col("o_orderkey").alias("id"), text.subfunction_code(label).alias("subfuncao"))


@query("n6_clean_name", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE upper(c_name) END AS nome FROM customer")
def _(t):
    k = F.col("c_custkey") % 3
    main = F.when(k == 0, F.concat(F.lit(" \t"), F.lower("c_name"), F.lit("  "))).when(k == 1, F.lit(""))
    other = F.when(k < 2, F.col("c_name"))
    return t.table("customer").select(F.col("c_custkey").alias("id"), text.clean_name(main, other).alias("nome"))


@query("n7_pad_code", "SELECT p_partkey AS id, CASE WHEN p_partkey >= 100 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 3, '0') END AS codigo FROM part")
def _(t):
    return t.table("part").select(F.col("p_partkey").alias("id"), text.pad_code(F.col("p_partkey"), 3).alias("codigo"))


@query("n8_classification_description", "SELECT p_partkey AS id, p_type || ' - ' || CASE WHEN p_size > 25 THEN '' ELSE p_brand END || ' - ' || p_name AS descricao FROM part")
def _(t):
    brand = F.when(F.col("p_size") <= 25, F.col("p_brand"))
    described = text.classification_description(F.col("p_type"), brand, F.col("p_name"))
    return t.table("part").select(F.col("p_partkey").alias("id"), described.alias("descricao"))


@query("n9_default_amounts", on_views("amendments", "SELECT id, CASE WHEN ano = 1997 THEN 0 ELSE valor_empenhado END::DOUBLE AS valor_empenhado FROM amendments"))
def _(t):
    known = F.when(F.col("ano") != 1997, F.col("valor_empenhado"))
    rows = t.amendments(author=False).withColumn("valor_empenhado", known)
    return plain_money(normalize.default_amounts(rows).select("id", "valor_empenhado"))


# Line items keyed by (order, line) hold real duplicates; all columns together give a total order.
ITEM_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
ITEM_SHOWN = "l_orderkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS l_shipdate, l_partkey, l_extendedprice"


def _item_sql(direction: str, keys: str = "l_orderkey, l_linenumber") -> str:
    order = ", ".join(f"{c} {direction}" for c in ITEM_ORDER)
    return f"""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_partkey, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r FROM lineitem) WHERE r = 1"""


def _items(df: DataFrame) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")
    return df.select("l_orderkey", "l_linenumber", day, "l_partkey", "l_extendedprice")


@query("u1_drop_invalid_codes", on_views("amendments", "SELECT id, codigo_emenda FROM amendments WHERE id % 10 NOT IN (7, 8, 9)"))
def _(t):
    last = F.col("id") % 10
    code = F.when(last == 9, F.lit("S/I")).when(last == 8, F.lit("")).when(last < 7, F.col("codigo_emenda"))
    rows = t.amendments(author=False).select("id", code.alias("codigo_emenda"))
    return integrity.drop_invalid_codes(rows)


@query("u2_dedup_first", _item_sql("ASC"))
def _(t):
    return _items(integrity.dedup_first(t.table("lineitem"), ["l_orderkey", "l_linenumber"], ITEM_ORDER))


@query("u3_dedup_last", _item_sql("DESC"))
def _(t):
    return _items(integrity.dedup_last(t.table("lineitem"), ["l_orderkey", "l_linenumber"], ITEM_ORDER))


@query(
    "u4_dedup_composite",
    on_views("classification", """SELECT funcao, subfuncao, programa, id, programa_nome FROM (
        SELECT *, row_number() OVER (PARTITION BY funcao, subfuncao, programa ORDER BY id) AS r FROM classification) WHERE r = 1"""),
)
def _(t):
    first = integrity.dedup_classification(t.classification, "id")
    return first.select("funcao", "subfuncao", "programa", "id", "programa_nome")


def _stored_and_batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Amendments before 1999 as the stored table; those from 1997 on, re-dated and doubled, as the batch."""
    rows = t.amendments(author=False).select("codigo_emenda", "ano", "tipo_emenda", "valor_empenhado")
    stored = rows.filter("ano < 1999").withColumn("embedding", F.concat(F.lit("v"), "codigo_emenda"))
    batch = rows.filter("ano >= 1997").withColumns(
        {"ano": F.col("ano") + 1, "valor_empenhado": (F.col("valor_empenhado") * 2).cast(money.AMOUNT), "embedding": F.lit("novo")}
    )
    return stored, batch


@query(
    "u5_insert_if_absent",
    on_views("amendments", """SELECT codigo_emenda, CAST(CASE WHEN ano < 1999 THEN ano ELSE ano + 1 END AS INTEGER) AS ano, tipo_emenda,
        (valor_empenhado * CASE WHEN ano < 1999 THEN 1 ELSE 2 END)::DOUBLE AS valor_empenhado,
        CASE WHEN ano < 1999 THEN 'v' || codigo_emenda ELSE 'novo' END AS embedding FROM amendments"""),
)
def _(t):
    return plain_money(integrity.insert_if_absent(*_stored_and_batch(t), "codigo_emenda"))


@query(
    "u6_upsert",
    on_views("amendments", """SELECT codigo_emenda, CAST(CASE WHEN ano < 1997 THEN ano ELSE ano + 1 END AS INTEGER) AS ano,
        CASE WHEN ano < 1999 THEN tipo_emenda END AS tipo_emenda,
        (valor_empenhado * CASE WHEN ano < 1997 THEN 1 ELSE 2 END)::DOUBLE AS valor_empenhado,
        CASE WHEN ano < 1997 THEN 'v' || codigo_emenda ELSE 'novo' END AS embedding FROM amendments"""),
)
def _(t):
    stored, batch = _stored_and_batch(t)
    return plain_money(integrity.upsert(stored, batch.drop("tipo_emenda"), "codigo_emenda"))


@query(
    "u7_upsert_keep",
    on_views("amendments", """SELECT codigo_emenda, CAST(CASE WHEN ano < 1997 THEN ano ELSE ano + 1 END AS INTEGER) AS ano, tipo_emenda,
        (valor_empenhado * CASE WHEN ano < 1997 THEN 1 ELSE 2 END)::DOUBLE AS valor_empenhado,
        CASE WHEN ano < 1999 THEN 'v' || codigo_emenda ELSE 'novo' END AS embedding FROM amendments"""),
)
def _(t):
    return plain_money(integrity.upsert_keep(*_stored_and_batch(t), "codigo_emenda"))


@query("u7_touched_partitions", on_views("amendments", "SELECT ano + 1 AS ano FROM amendments WHERE ano >= 1997 UNION SELECT ano FROM amendments WHERE ano IN (1997, 1998)"))
def _(t):
    return integrity.touched_partitions(*_stored_and_batch(t), "codigo_emenda", "ano")


@query(
    "u8_link_author",
    on_views(
        "amendments",
        """SELECT a.id, coalesce(l.cod_autor, -1) AS cod_autor FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 5 = 0 THEN 'desconhecido'
               WHEN id % 3 = 0 THEN substr(nome_autor, 12) ELSE lower(nome_autor) END AS nome_autor FROM amendments) a
           LEFT JOIN (SELECT pedaco, min(cod_autor) AS cod_autor FROM (
               SELECT cod_autor, nome AS pedaco FROM legislators UNION ALL
               SELECT l.cod_autor, p.pedaco FROM legislators l JOIN (SELECT DISTINCT substr(nome, 12) AS pedaco FROM legislators) p
               ON contains(l.nome, p.pedaco)) GROUP BY 1) l ON upper(a.nome_autor) = l.pedaco""",
    ),
)
def _(t):
    rows = t.amendments().select("id", "nome_autor")
    name = (
        F.when(F.col("id") % 7 == 0, F.lit(""))
        .when(F.col("id") % 5 == 0, F.lit("desconhecido"))
        .when(F.col("id") % 3 == 0, F.substring("nome_autor", 12, 200))
        .otherwise(F.lower("nome_autor"))
    )
    linked = integrity.link_author(rows.withColumn("nome_autor", name), t.legislators)
    return linked.select("id", F.coalesce("cod_autor", F.lit(-1)).alias("cod_autor"))


@query(
    "u9_load_report",
    on_views(
        "amendments",
        """SELECT ano, count(*) FILTER (r = 1 AND id % 5 < 4 AND NOT (id % 4 = 0)) AS inseridas,
               count(*) FILTER (r = 1 AND id % 5 < 4 AND id % 4 = 0) AS atualizadas,
               count(*) FILTER (r > 1 OR id % 5 = 4) AS ignoradas FROM (
               SELECT *, row_number() OVER (PARTITION BY id, id % 5 = 4 ORDER BY ano, copia) AS r FROM (
                   SELECT id, ano, 1 AS copia FROM amendments UNION ALL
                   SELECT id, CAST(ano + 1 AS INTEGER), 2 FROM amendments WHERE id % 2 = 0)) GROUP BY ano""",
    ),
)
def _(t):
    """A batch with invalid codes and repeated codes across years, against a target with every fourth code."""
    valid = F.when(F.col("id") % 5 < 4, F.col("codigo_emenda")).otherwise(F.lit("S/I"))
    rows = t.amendments(author=False).select("id", "ano", valid.alias("codigo_emenda"))
    copies = rows.withColumn("copia", F.lit(1)).unionByName(
        rows.filter(F.col("id") % 2 == 0).withColumns({"ano": F.col("ano") + 1, "copia": F.lit(2)})
    )
    target = t.amendments(author=False).filter(F.col("id") % 4 == 0)
    return integrity.load_report(copies, target, ["ano", "copia"])


@query(
    "u10_orphans",
    on_views("movements amendments", "SELECT emenda_id, fase, valor::DOUBLE AS valor FROM movements WHERE emenda_id NOT IN (SELECT id FROM amendments WHERE tipo_emenda <> 'Comissão')"),
)
def _(t):
    kept = t.amendments(author=False).filter("tipo_emenda <> 'Comissão'")
    lost = integrity.orphans(t.movements, kept, "emenda_id", "id")
    return plain_money(lost.select("emenda_id", "fase", "valor"))


@query(
    "u10_cascade_delete",
    on_views("movements amendments", """SELECT fase, count(*) AS qtd, sum(valor)::DOUBLE AS valor FROM movements
        WHERE emenda_id NOT IN (SELECT id FROM amendments WHERE tipo_emenda = 'Bancada') GROUP BY fase"""),
)
def _(t):
    deleted = t.amendments(author=False).filter("tipo_emenda = 'Bancada'")
    left = integrity.cascade_delete(t.movements, deleted, "emenda_id", "id")
    return plain_money(left.groupBy("fase").agg(F.count("*").alias("qtd"), F.sum("valor").alias("valor")))
