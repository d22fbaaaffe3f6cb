"""Registered queries: whole runs, from raw input to stored or answered rows."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from erario.functions.fixed_values import PORTAL
from erario.plans.answer import answer_questions, evaluation_report, score_extraction
from erario.plans.ingest import insert_amendments, load_amendments, load_legislators, load_partitions, new_classification_vectors, new_vectors
from erario.plans.queries_ingest import NORMALIZED_SQL, land_amendments, raw_amendments
from erario.plans.queries_search import LINE_SQL
from erario.plans.registry import query
from erario.plans.views import on_views, plain_money
from erario.sources import writers
from erario.sources.partitions import read_partitioned
from erario.streaming.landing import land

AREA_OF_CODE = {"01": "legislativa", "02": "judiciária", "03": "relacoes exteriores", "04": "administração", "05": "defesa nacional"}
STORED_COLUMNS = "codigo_emenda, cod_autor, nome_autor, ano, uf, valor_empenhado, embedding"


def _stored(t):
    """A table that already holds the first years, with other values."""
    return t.amendments().filter("ano < 1997").select(
        F.col("id").cast("string").alias("codigo_emenda"), "cod_autor", "nome_autor", "ano", F.lit("ZZ").alias("uf"),
        F.lit(1).cast("decimal(15,2)").alias("valor_empenhado"), F.concat(F.lit("v"), "id").alias("embedding"),
    )


@query(
    "run_load_amendments",
    on_views(
        "amendments",
        """SELECT CAST(id AS VARCHAR) AS codigo_emenda, cod_autor, nome_autor, ano, CASE WHEN id % 10 = 9 THEN 'ZZ' ELSE uf END AS uf,
           CASE WHEN id % 10 = 9 THEN 1 ELSE valor_empenhado END AS valor_empenhado, CASE WHEN ano < 1997 THEN 'v' || id ELSE '' END AS embedding
           FROM (SELECT n.*, a.cod_autor FROM n JOIN amendments a USING (id)) WHERE id % 10 < 9 OR ano < 1997""",
        n=NORMALIZED_SQL,
    ),
)
def _(t):
    """Raw records with invalid and repeated codes, loaded over a table that already holds the first years."""
    raw = writers.written(raw_amendments(t), "brutas").withColumn("ordem", F.lit(1))
    copies = raw.filter(F.col("id") % 3 == 0).withColumns({"ordem": F.lit(2), "ano": F.col("ano") + 1})
    loaded = load_amendments(raw.unionByName(copies), t.legislators, _stored(t), ["ano", "ordem"])
    shown = loaded.select(*STORED_COLUMNS.split(", ")).withColumn("embedding", F.coalesce("embedding", F.lit("")))
    return plain_money(shown)


@query(
    "run_load_partitions",
    on_views(
        "amendments",
        """SELECT CAST(id AS VARCHAR) AS codigo_emenda, cod_autor, nome_autor, ano, CASE WHEN ano < 1996 OR id % 10 = 9 THEN 'ZZ' ELSE uf END AS uf,
           CASE WHEN ano < 1996 OR id % 10 = 9 THEN 1 ELSE valor_empenhado END AS valor_empenhado, CASE WHEN ano < 1997 THEN 'v' || id ELSE '' END AS embedding
           FROM (SELECT n.*, a.cod_autor FROM n JOIN amendments a USING (id)) WHERE id % 10 < 9 OR ano < 1997""",
        n=NORMALIZED_SQL,
    ),
)
def _(t):
    """Later years loaded into a stored table, twice; a quarter of one year was stored under a year that the load empties."""
    path = writers.scratch_path(t.spark, "emendas")
    misdated = (F.col("ano") == 1996) & (F.col("codigo_emenda").cast("long") % 4 == 0)
    writers.write_table(_stored(t).withColumn("ano", F.when(misdated, 1990).otherwise(F.col("ano"))), path)
    raw = writers.written(raw_amendments(t).filter("ano >= 1996"), "brutas").withColumn("ordem", F.lit(1))
    for _run in range(2):
        load_partitions(raw, t.legislators, path, ["ano", "ordem"])
    loaded = read_partitioned(t.spark, path, StructField("ano", IntegerType()))
    return plain_money(loaded.select(*STORED_COLUMNS.split(", ")).withColumn("embedding", F.coalesce("embedding", F.lit(""))))


@query(
    "run_insert_amendments",
    on_views(
        "amendments",
        """SELECT CAST(id AS VARCHAR) AS codigo_emenda, cod_autor, nome_autor, ano, CASE WHEN ano < 1997 THEN 'ZZ' ELSE uf END AS uf,
           CASE WHEN ano < 1997 THEN 1 ELSE valor_empenhado END AS valor_empenhado, CASE WHEN ano < 1997 THEN 'v' || id ELSE '' END AS embedding
           FROM (SELECT n.*, a.cod_autor FROM n JOIN amendments a USING (id)) WHERE id % 10 < 9 OR ano < 1997""",
        n=NORMALIZED_SQL,
    ),
)
def _(t):
    """The same raw records, where codes already stored stay untouched."""
    raw = writers.written(raw_amendments(t), "brutas").withColumn("ordem", F.lit(1))
    loaded = insert_amendments(raw, t.legislators, _stored(t), ["ano", "ordem"])
    shown = loaded.select(*STORED_COLUMNS.split(", ")).withColumn("embedding", F.coalesce("embedding", F.lit("")))
    return plain_money(shown)


@query(
    "run_load_legislators",
    on_views(
        "legislators",
        """SELECT cod_autor, nome, CASE WHEN cod_autor % 5 = 0 THEN 'NOVO' WHEN cod_autor % 2 = 0 THEN partido ELSE 'ANTIGO' END AS partido, uf,
           CASE WHEN cod_autor % 2 = 0 THEN '57' ELSE '50' END AS legislaturas, CASE WHEN cod_autor % 2 = 0 THEN '' ELSE 'civil' END AS nome_civil
           FROM (SELECT * FROM legislators WHERE cod_autor % 5 > 0 OR cod_autor % 2 = 0)""",
    ),
)
def _(t):
    """Legislators listed twice with a new party, over stored ones; even ids are in the batch, odd ones only stored."""
    first = t.legislators.filter(F.col("cod_autor") % 2 == 0).select(
        F.col("cod_autor").alias("id"), F.lower("nome").alias("nome"), F.col("partido").alias("siglaPartido"), F.col("uf").alias("siglaUf"),
        F.lit(None).cast("int").alias("idLegislatura"), F.lit("").alias("urlFoto"), F.lit(1).alias("ordem"),
    )
    later = first.filter(F.col("id") % 5 == 0).withColumns({"siglaPartido": F.lit("NOVO"), "ordem": F.lit(2)})
    stored = t.legislators.filter((F.col("cod_autor") % 2 == 1) & (F.col("cod_autor") % 5 > 0)).select(
        "cod_autor", "nome", F.lit("ANTIGO").alias("partido"), "uf", F.array(F.lit(50)).alias("legislaturas"), F.lit("civil").alias("nome_civil")
    )
    loaded = load_legislators(later.unionByName(first), stored, ["ordem"])
    shown = F.array_join(F.col("legislaturas").cast("array<string>"), ",").alias("legislaturas")
    return loaded.select("cod_autor", "nome", "partido", "uf", shown, F.coalesce("nome_civil", F.lit("")).alias("nome_civil"))


@query("run_new_classification_vectors", on_views("classification vectors", """SELECT id, funcao, funcao_nome || ' ' || subfuncao_nome || ' ' || programa_nome || ' None' AS texto,
    64 AS dimensoes FROM classification WHERE id NOT IN (SELECT id FROM vectors)"""))
def _(t):
    rows = t.classification.withColumn("descricao", F.lit(None).cast("string"))
    return new_classification_vectors(rows, t.vectors, dim=64).select("id", "funcao", "texto", F.size("embedding").alias("dimensoes"))


@query("run_new_vectors", on_views("amendments vectors", """SELECT id, nome_autor || ' | ' || funcao_nome || ' | ' || subfuncao_nome || ' | UF: ' || uf || ' | Ano: ' || ano AS texto,
    384 AS dimensoes FROM amendments WHERE id NOT IN (SELECT id FROM vectors)"""))
def _(t):
    return new_vectors(t.amendments(), t.vectors).select("id", "texto", F.size("embedding").alias("dimensoes"))


@query(
    "run_stream_landing",
    on_views("amendments", "SELECT ano, count(*) AS qtd, sum(valor_empenhado)::DOUBLE AS empenhado, count(DISTINCT cod_autor) AS autores FROM amendments WHERE id % 10 < 9 GROUP BY ano"),
)
def _(t):
    """Two stream runs over the same landing folder; the second finds nothing new."""
    landing, table = land_amendments(t), writers.scratch_path(t.spark, "emendas")
    checkpoint = writers.scratch_path(t.spark, "posicao")
    for _run in range(2):
        land(t.spark, landing, t.legislators, table, checkpoint).awaitTermination()
    stored = t.spark.read.parquet(table)
    totals = stored.groupBy("ano").agg(
        F.count("*").alias("qtd"), F.sum("valor_empenhado").alias("empenhado"), F.countDistinct("cod_autor").alias("autores")
    )
    return plain_money(totals)


def _asked(t):
    """One question for every year, type, function and party that occurs."""
    seen = t.amendments(author=False).join(t.legislators.select("cod_autor", "partido"), "cod_autor")
    seen = seen.select("ano", "tipo_emenda", "funcao", "partido").distinct()
    area = F.coalesce(*[F.when(F.col("funcao") == code, F.lit(name)) for code, name in AREA_OF_CODE.items()])
    asked = F.concat_ws(" ", F.lit("Qual o total das emendas de"), F.lower("tipo_emenda"), F.lit("em"), area, F.lit("do partido"), "partido", F.lit("em"), "ano")
    return seen.select(F.concat_ws("|", "ano", "tipo_emenda", "funcao", "partido").alias("id_consulta"), F.concat(asked, F.lit("?")).alias("consulta"))


ASKED_SQL = "SELECT DISTINCT ano || '|' || tipo_emenda || '|' || funcao || '|' || partido_autor AS id_consulta, ano, tipo_emenda, funcao, partido_autor FROM amendments"
FOUND_SQL = """SELECT * FROM (SELECT asked.id_consulta, a.*, CAST(row_number() OVER (PARTITION BY asked.id_consulta ORDER BY valor_empenhado DESC, a.id) AS INTEGER) AS posicao
    FROM asked JOIN amendments a USING (ano, tipo_emenda, funcao, partido_autor) WHERE tipo_emenda <> 'Comissão') WHERE posicao <= 20"""


@query(
    "run_answer_questions",
    on_views(
        "amendments",
        f"""SELECT id_consulta, 'sql' AS modo, CAST(count(f.id) AS INTEGER) AS num_resultados, coalesce(string_agg({LINE_SQL.replace('id_consulta', 'f.id_consulta')}, chr(10) ORDER BY posicao), 'Nenhum dado encontrado.') AS contexto,
            CASE WHEN count(f.id) > 0 THEN '{PORTAL},https://dadosabertos.camara.leg.br' ELSE '{PORTAL}' END AS fontes
            FROM (SELECT id_consulta FROM asked) q LEFT JOIN found f USING (id_consulta) GROUP BY id_consulta""",
        asked=ASKED_SQL, found=FOUND_SQL,
    ),
)
def _(t):
    """Text to ranked rows, context and sources; 'comissao' never matches the accented type, as published."""
    answers, _rows = answer_questions(_asked(t), t.amendments(paid=True), t.legislators)
    shown = answers.select("id_consulta", "modo", "num_resultados", "contexto", F.array_join("fontes", ",").alias("fontes"))
    return shown


@query(
    "run_answer_figures",
    on_views(
        "amendments",
        """SELECT id_consulta, 'total' AS operacao, coalesce(sum(valor_empenhado), 0)::DOUBLE AS valor, count(a.id) AS qtd
           FROM asked LEFT JOIN (SELECT * FROM amendments WHERE tipo_emenda <> 'Comissão') a USING (ano, tipo_emenda, funcao, partido_autor) GROUP BY 1""",
        asked=ASKED_SQL,
    ),
)
def _(t):
    """The totals that the same questions ask for, beside their rows."""
    answers, _rows = answer_questions(_asked(t), t.amendments(paid=True), t.legislators)
    figures = answers.select("id_consulta", F.inline("figuras"))
    return plain_money(figures.select("id_consulta", "operacao", "valor", "qtd"))


@query(
    "run_score_extraction",
    on_views(
        "amendments",
        """SELECT substr(id_consulta, 1, 1) AS tipo, count(*) AS total, count(*) FILTER (ano <> 1999) AS sucessos,
           round(avg(CASE WHEN tipo_emenda = 'Comissão' THEN 0.75 ELSE 1 END) FILTER (ano <> 1999), 4) AS precisao,
           round(avg(ano % 10) FILTER (ano <> 1999), 4) AS latencia_media_ms FROM asked GROUP BY 1""",
        asked=ASKED_SQL,
    ),
)
def _(t):
    """Extraction scored against what the questions were made from; the accented type counts as a miss."""
    asked = _asked(t)
    parts = F.split("id_consulta", r"\|")
    codes = F.create_map(*[x for code, name in AREA_OF_CODE.items() for x in (F.lit(code), F.lit(name))])
    expected = F.create_map(
        F.lit("ano"), parts[0], F.lit("tipo_emenda"), F.lower(parts[1]), F.lit("area"), codes[parts[2]], F.lit("partido"), parts[3]
    )
    year = parts[0].cast("int")
    log = asked.select("id_consulta", (year % 10).alias("latencia_ms"), (year != 1999).alias("sucesso"))
    return evaluation_report(score_extraction(asked.withColumn("esperado", expected), t.legislators), log)
