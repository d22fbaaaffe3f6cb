"""Registered queries: the operation that each question of a table asks for."""

from pyspark.sql import DataFrame, functions as F

from erario.operators import operations, sketches, vectors
from erario.operators.filters import with_party
from erario.plans.queries_search import _text_questions
from erario.plans.registry import query
from erario.plans.views import Tables, on_views, plain_money
from erario.sources import writers

AXES = ["ano", "uf", "partido"]
NAME_SQL = "concat_ws('|', coalesce(CAST(ano AS VARCHAR), '*'), coalesce(uf, '*'), coalesce(partido_autor, '*'))"
#: One question for each combination of year, state and party that occurs, and for each part of it; years beyond the data find nothing.
P_SQL = f"""SELECT {NAME_SQL} AS id_consulta, ano, uf, partido_autor AS partido FROM amendments GROUP BY CUBE (ano, uf, partido_autor)
    UNION ALL SELECT '1900|*|*', 1900, NULL, NULL"""
HELD_SQL = "p LEFT JOIN amendments a ON (p.ano IS NULL OR p.ano = a.ano) AND (p.uf IS NULL OR p.uf = a.uf) AND (p.partido IS NULL OR p.partido = a.partido_autor)"
#: Questions over a span of years, by state and party.
SPAN_SQL = "SELECT coalesce(uf, '*') || '|' || coalesce(partido_autor, '*') AS id_consulta, uf, partido_autor AS partido FROM amendments GROUP BY CUBE (uf, partido_autor)"
SPAN_HELD_SQL = "p JOIN amendments a ON a.ano BETWEEN 1993 AND 1997 AND (p.uf IS NULL OR p.uf = a.uf) AND (p.partido IS NULL OR p.partido = a.partido_autor)"
SUMS = "sum(valor_empenhado)::DOUBLE AS valor, count(*) AS qtd"


def _cube(t: Tables, axes: list[str]) -> DataFrame:
    found = with_party(t.amendments(), t.legislators).cube(*axes).agg(F.count("*").alias("linhas"))
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in axes])
    return found.select(name.alias("id_consulta"), *axes)


def _figures(t: Tables, operation: str, axes: list[str] = AXES, paid: bool = False, **more) -> DataFrame:
    asked = _cube(t, axes)
    if axes == AXES:
        nothing = t.spark.range(1).select(F.lit("1900|*|*").alias("id_consulta"), F.lit(1900).alias("ano"), *[F.lit(None).cast("string").alias(c) for c in AXES[1:]])
        asked = asked.unionByName(nothing)
    asked = asked.withColumns({"operacao": F.lit(operation)} | {name: F.lit(value) for name, value in more.items()})
    return plain_money(operations.figures(writers.written(asked, "perguntas"), t.amendments(paid=paid), t.legislators, n=3))


@query("d7_operation_total", on_views("amendments", f"SELECT id_consulta, coalesce(sum(valor_empenhado), 0)::DOUBLE AS valor, count(a.id) AS qtd FROM {HELD_SQL} GROUP BY 1", p=P_SQL))
def _(t):
    return _figures(t, "total").select("id_consulta", "valor", "qtd")


@query(
    "d7_operation_mean",
    on_views("amendments", f"""SELECT id_consulta, CASE WHEN count(a.id) > 0 THEN ((2 * CAST(sum(valor_empenhado) * 100 AS HUGEINT) + count(a.id)) // (2 * count(a.id)))::DOUBLE / 100 END AS valor, count(a.id) AS qtd
        FROM {HELD_SQL} GROUP BY 1""", p=P_SQL),
)
def _(t):
    return _figures(t, "media").select("id_consulta", "valor", "qtd")


@query(
    "d7_operation_ratio",
    on_views("amendments", f"""SELECT id_consulta, coalesce(sum(valor_empenhado), 0)::DOUBLE AS valor, coalesce(sum(valor_pago), 0)::DOUBLE AS pago,
        round(sum(valor_pago)::DOUBLE / nullif(sum(valor_empenhado)::DOUBLE, 0), 6) AS variacao FROM {HELD_SQL} GROUP BY 1""", p=P_SQL),
)
def _(t):
    return _figures(t, "proporcao", paid=True).select("id_consulta", "valor", "pago", "variacao")


@query(
    "d7_operation_ranking",
    on_views("amendments", f"""SELECT * FROM (SELECT id_consulta, nome_autor AS grupo, {SUMS}, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY sum(valor_empenhado) DESC, nome_autor) AS INTEGER) AS posicao
        FROM {HELD_SQL} WHERE a.id IS NOT NULL GROUP BY 1, 2) WHERE posicao <= 3""", p=P_SQL),
)
def _(t):
    return _figures(t, "ranking").select("id_consulta", "grupo", "valor", "qtd", "posicao")


@query(
    "d7_operation_ranking_of_parties",
    on_views("amendments", f"""SELECT * FROM (SELECT id_consulta, partido_autor AS grupo, {SUMS}, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY sum(valor_empenhado) DESC, partido_autor) AS INTEGER) AS posicao
        FROM {HELD_SQL} WHERE a.id IS NOT NULL GROUP BY 1, 2) WHERE posicao <= 3""", p=P_SQL),
)
def _(t):
    """Which party gave most: the question names the dimension."""
    return _figures(t, "ranking", dimensao="partido").select("id_consulta", "grupo", "valor", "qtd", "posicao")


@query("d7_operation_distinct", on_views("amendments", f"SELECT id_consulta, count(DISTINCT nome_autor) AS qtd FROM {HELD_SQL} GROUP BY 1", p=P_SQL))
def _(t):
    return _figures(t, "contagem_distinta").select("id_consulta", "qtd")


@query("d7_operation_list", on_views("amendments", f"SELECT DISTINCT id_consulta, nome_autor AS grupo FROM {HELD_SQL} WHERE a.id IS NOT NULL", p=P_SQL))
def _(t):
    return _figures(t, "lista").select("id_consulta", "grupo")


@query("d7_operation_compare", on_views("amendments", f"SELECT id_consulta, a.tipo_emenda AS grupo, a.ano, {SUMS} FROM {HELD_SQL} WHERE a.id IS NOT NULL GROUP BY 1, 2, 3", p=P_SQL))
def _(t):
    return _figures(t, "comparacao").select("id_consulta", "grupo", "ano", "valor", "qtd")


@query(
    "d7_operation_trend",
    on_views("amendments", f"""SELECT id_consulta, a.ano, {SUMS}, (sum(valor_empenhado) - lag(sum(valor_empenhado)) OVER (PARTITION BY id_consulta ORDER BY a.ano))::DOUBLE AS variacao
        FROM {SPAN_HELD_SQL} GROUP BY 1, 2""", p=SPAN_SQL),
)
def _(t):
    return _figures(t, "tendencia", AXES[1:], ano_inicio=1993, ano_fim=1997).select("id_consulta", "ano", "valor", "qtd", "variacao")


@query(
    "d7_operation_growth",
    on_views("amendments", f"""SELECT *, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY variacao DESC, grupo) AS INTEGER) AS posicao FROM (
        SELECT id_consulta, a.funcao AS grupo, (coalesce(sum(valor_empenhado) FILTER (a.ano = 1997), 0) - coalesce(sum(valor_empenhado) FILTER (a.ano = 1993), 0))::DOUBLE AS variacao
        FROM {SPAN_HELD_SQL} WHERE a.ano IN (1993, 1997) GROUP BY 1, 2)""", p=SPAN_SQL),
)
def _(t):
    return _figures(t, "crescimento", AXES[1:], ano_inicio=1993, ano_fim=1997).select("id_consulta", "grupo", "variacao", "posicao")


@query(
    "d7_operation_text_filters",
    on_views(
        "amendments regions",
        """SELECT id_consulta, operacao, CASE operacao WHEN 'total' THEN coalesce(sum(valor_empenhado), 0)::DOUBLE ELSE count(DISTINCT nome_autor)::DOUBLE END AS figura
           FROM p LEFT JOIN amendments a ON (p.k <> 4 OR a.ano = 1997) AND (p.k >= 3 OR a.ano BETWEEN p.k + 1995 AND p.k + 1997)
           AND (CASE WHEN p.k % 2 = 0 THEN a.uf = p.uf ELSE list_contains(p.ufs, a.uf) END) AND (p.k = 1 OR a.nome_autor ILIKE '%0_' || p.k || '%')
           AND (p.partido IS NULL OR p.partido = a.partido_autor) AND (p.k <= 1 OR a.tipo_emenda ILIKE '%individ%') GROUP BY 1, 2""",
        r="SELECT nome, ufs, unnest(ufs) AS uf, generate_subscripts(ufs, 1) - 1 AS k FROM regions",
        p="""SELECT r.*, x.partido, concat_ws('|', nome, uf, coalesce(x.partido, '*')) AS id_consulta, unnest(['total', 'contagem_distinta']) AS operacao FROM r
             LEFT JOIN (SELECT DISTINCT partido FROM legislators) x ON length(x.partido) = k + 6""",
    ),
)
def _(t):
    """Totals and counts under name and type texts, spans of years and lists of states."""
    both = F.explode(F.array(F.lit("total"), F.lit("contagem_distinta")))
    asked = writers.written(_text_questions(t).withColumn("operacao", both), "perguntas")
    found = operations.figures(asked.withColumn("id_consulta", F.concat_ws("#", "id_consulta", "operacao")), t.amendments(), t.legislators)
    figure = F.when(F.col("operacao") == "total", F.col("valor").cast("double")).otherwise(F.col("qtd").cast("double"))
    return found.select(F.substring_index("id_consulta", "#", 1).alias("id_consulta"), "operacao", figure.alias("figura"))


@query(
    "v7_semantic_topk_many",
    on_views("vectors", """SELECT id_consulta, id, posicao FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY s DESC, id) AS INTEGER) AS posicao FROM (
        SELECT q.id AS id_consulta, v.id, round(list_cosine_similarity(q.embedding, v.embedding), 9) AS s FROM vectors q, vectors v) WHERE s >= 0.45) WHERE posicao <= 20"""),
)
def _(t):
    """Every vector asks."""
    asked = t.vectors.select(F.col("id").alias("id_consulta"), "embedding")
    return vectors.semantic_topk(asked, t.vectors.select("id", "embedding")).select("id_consulta", "id", "posicao")


@query(
    "v10_hybrid_prefilter_filters",
    on_views(
        "vectors amendments",
        """SELECT id_consulta, id, posicao FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY s DESC, id) AS INTEGER) AS posicao FROM (
           SELECT p.id_consulta, v.id, round(list_cosine_similarity(p.embedding, v.embedding), 9) AS s
           FROM p JOIN amendments a ON a.ano BETWEEN p.ano_inicio AND p.ano_fim AND (p.funcao IS NULL OR a.funcao = p.funcao) AND (p.autor IS NULL OR a.nome_autor LIKE '%' || p.autor || '%') JOIN vectors v ON v.id = a.id)) WHERE posicao <= 5""",
        p="""SELECT id AS id_consulta, embedding, 1992 + id % 7 AS ano_inicio, 1992 + id % 7 + id // 7 % 4 AS ano_fim, CASE WHEN id % 3 > 0 THEN '0' || (1 + id % 5) END AS funcao,
             CASE WHEN id % 2 = 0 THEN lpad(CAST(id % 100 AS VARCHAR), 2, '0') END AS autor FROM vectors""",
    ),
)
def _(t):
    """Every vector asks, with a filter set of its own: a span of years, often a function, often a piece of the author's name."""
    k = F.col("id")
    asked = t.vectors.select(
        k.alias("id_consulta"), "embedding", (1992 + k % 7).cast("int").alias("ano_inicio"), (1992 + k % 7 + F.floor(k / 7) % 4).cast("int").alias("ano_fim"),
        F.when(k % 3 > 0, F.concat(F.lit("0"), 1 + k % 5)).alias("funcao"), F.when(k % 2 == 0, F.lpad((k % 100).cast("string"), 2, "0")).alias("autor"),
    )
    ranked = t.amendments().join(t.vectors.select("id"), "id", "left_semi")  # the others have nothing to rank
    numbered, passed = operations.passed_filters(asked, ranked, t.legislators)
    questions = numbered.join(asked.select("id_consulta", "embedding"), "id_consulta")
    return vectors.hybrid_prefilter_filters(questions, t.vectors.select("id", "embedding"), passed).select("id_consulta", "id", "posicao")


@query(
    "o4_count_distinct_sketches",
    on_views("amendments", """SELECT concat_ws('|', coalesce(CAST(ano AS VARCHAR), '*'), coalesce(uf, '*'), coalesce(funcao, '*')) AS id_consulta, count(DISTINCT nome_autor) AS distintos, true AS dentro
        FROM amendments GROUP BY CUBE (ano, uf, funcao)"""),
)
def _(t):
    """A question for each combination of keys and each part of it: sketches of odd and even ids, merged, lie within a tenth of the exact counts."""
    rows = t.amendments()
    halves = [sketches.distinct_sketches(rows.filter(F.col("id") % 2 == half)) for half in range(2)]
    stored = writers.written(sketches.merge_sketches(*halves), "esbocos")
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in sketches.KEYS])
    exact = writers.written(rows.cube(*sketches.KEYS).agg(F.countDistinct("nome_autor").alias("exato")).withColumn("id_consulta", name), "exatos")
    found = sketches.count_distinct_many(exact.select("id_consulta", *sketches.KEYS), stored).join(exact.select("id_consulta", "exato"), "id_consulta")
    return found.select("id_consulta", F.col("exato").alias("distintos"), (F.abs(F.col("distintos") - F.col("exato")) <= 0.1 * F.col("exato")).alias("dentro"))
