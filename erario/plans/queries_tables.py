"""Registered queries: filters, joins, listings, aggregates, declared operations, presentation, log."""

from pyspark.sql import functions as F

from erario.functions import links, money, predicates as p, text
from erario.operators import aggregates as agg, filters, listing, present, question_log
from erario.plans.registry import query
from erario.plans.views import on_views, plain_money
from erario.functions.fixed_values import MOVEMENT_PHASES

ROW = "id, nome_autor, ano, uf, funcao, valor_empenhado::DOUBLE AS valor_empenhado"
ROW_COLUMNS = ["id", "nome_autor", "ano", "uf", "funcao", "valor_empenhado"]


def _filter_query(name: str, condition: str, predicate) -> None:
    @query(name, on_views("amendments", f"SELECT {ROW} FROM amendments WHERE {condition}"))
    def _(t):
        return plain_money(t.amendments().filter(predicate()).select(*ROW_COLUMNS))


_filter_query("f1_year", "ano = 1998", lambda: p.equals("ano", 1998))
_filter_query("f2_year_range", "ano BETWEEN 1996 AND 1998", lambda: p.between("ano", 1996, 1998))
_filter_query("f3_state", "uf = 'NATION_7'", lambda: p.equals_upper("uf", "nation_7"))
_filter_query("f4_states", "uf IN ('NATION_1', 'NATION_12', 'NATION_20')", lambda: p.one_of("uf", ["NATION_1", "NATION_12", "NATION_20"]))
_filter_query("f5_author", "nome_autor ILIKE '%r#0000_01%'", lambda: p.contains_text("nome_autor", "r#0000_01"))
_filter_query("f7_function", "funcao = '03'", lambda: p.equals("funcao", "03"))
_filter_query("f7_subfunction", "subfuncao = '024'", lambda: p.equals("subfuncao", "024"))
_filter_query("f8_type", "tipo_emenda ILIKE '%COMISSÃO%'", lambda: p.contains_text("tipo_emenda", "COMISSÃO"))
_filter_query("f10_pattern", "funcao_nome ILIKE '%hi_h%'", lambda: p.like_ignoring_case("funcao_nome", "%hi_h%"))


@query("f6_party", on_views("amendments", f"SELECT {ROW}, partido_autor AS partido FROM amendments WHERE partido_autor = 'BUILDING'"))
def _(t):
    rows = filters.filter_with_party(t.amendments(), t.legislators, {"partido": "BUILDING"})
    return plain_money(rows.select(*ROW_COLUMNS, "partido"))


ALL_FILTERS = {
    "ano_inicio": 1995, "ano_fim": 1999, "ufs": ["NATION_3", "NATION_8", "NATION_15"], "autor": "customer", "partido": "MACHINERY",
    "funcao": "02", "tipo_emenda": "a",
}


@query(
    "f9_dynamic_filter",
    on_views(
        "amendments",
        f"""SELECT {ROW} FROM amendments WHERE ano BETWEEN 1995 AND 1999 AND uf IN ('NATION_3', 'NATION_8', 'NATION_15')
            AND nome_autor ILIKE '%customer%' AND partido_autor = 'MACHINERY' AND funcao = '02' AND tipo_emenda ILIKE '%a%'""",
    ),
)
def _(t):
    rows = filters.filter_with_party(t.amendments(), t.legislators, ALL_FILTERS)
    return plain_money(rows.select(*ROW_COLUMNS))


@query("f9_no_filter", on_views("amendments", "SELECT count(*) AS total FROM amendments"))
def _(t):
    return agg.total_count(filters.dynamic_filter(t.amendments(author=False), {"ano": 0, "uf": ""}))


@query(
    "j1_with_party",
    on_views("amendments", "SELECT id, cod_autor, CASE WHEN cod_autor % 4 > 0 THEN partido_autor ELSE '' END AS partido FROM amendments"),
)
def _(t):
    known = t.legislators.filter(F.col("cod_autor") % 4 > 0)
    joined = filters.with_party(t.amendments(author=False), known)
    return joined.select("id", "cod_autor", F.coalesce("partido", F.lit("")).alias("partido"))


@query("j2_restrict_to_codes", on_views("amendments", "SELECT id, ano FROM amendments WHERE id IN (SELECT id FROM paid)"))
def _(t):
    paid = t.movements.filter("fase = 'pagamento'").select(F.col("emenda_id").alias("id"))
    return filters.restrict_to(t.amendments(author=False), paid, "id").select("id", "ano")


@query(
    "j3_movement_totals",
    on_views(
        "amendments movements",
        """SELECT a.id, valor_empenhado::DOUBLE AS valor_empenhado, coalesce(sum(valor) FILTER (fase = 'empenho'), 0)::DOUBLE AS empenho,
           coalesce(sum(valor) FILTER (fase = 'liquidacao'), 0)::DOUBLE AS liquidacao,
           coalesce(sum(valor) FILTER (fase = 'pagamento'), 0)::DOUBLE AS pagamento
           FROM amendments a LEFT JOIN movements ON emenda_id = a.id GROUP BY a.id, valor_empenhado""",
    ),
)
def _(t):
    rows = filters.with_movements(t.amendments(author=False).select("id", "valor_empenhado"), t.movements, MOVEMENT_PHASES)
    return plain_money(rows)


SEARCH_SQL = """id, codigo_emenda, cod_autor, nome_autor, ano, tipo_emenda, funcao_nome, subfuncao_nome, uf, localidade,
    valor_empenhado::DOUBLE AS valor_empenhado, valor_liquidado::DOUBLE AS valor_liquidado, valor_pago::DOUBLE AS valor_pago, partido_autor AS partido"""
URLS_SQL = """'https://portaldatransparencia.gov.br/emendas/detalhe?codigoEmenda=' || codigo_emenda AS source_url,
    CASE WHEN cod_autor <> 0 THEN 'https://www.camara.leg.br/deputados/' || cod_autor END AS parlamentar_url"""
BY_AMOUNT = "ORDER BY valor_empenhado DESC, id"


@query(
    "l1_search",
    on_views("amendments", f"SELECT {SEARCH_SQL} FROM amendments WHERE ano = 1997 AND funcao = '01' {BY_AMOUNT} LIMIT 20"),
)
def _(t):
    return plain_money(listing.search(t.amendments(paid=True), t.legislators, {"ano": 1997, "funcao": "01"}))


@query(
    "l1_search_by_party",
    on_views("amendments", f"SELECT {SEARCH_SQL} FROM amendments WHERE uf = 'NATION_4' AND partido_autor = 'FURNITURE' {BY_AMOUNT} LIMIT 20"),
)
def _(t):
    return plain_money(listing.search(t.amendments(paid=True), t.legislators, {"uf": "NATION_4", "partido": "FURNITURE"}))


PAGE = {"ano": 1998, "partido": "building"}


@query(
    "l2_list_amendments",
    on_views("amendments", f"SELECT {SEARCH_SQL}, {URLS_SQL} FROM amendments WHERE ano = 1998 AND partido_autor = 'BUILDING' {BY_AMOUNT} LIMIT 20"),
)
def _(t):
    return plain_money(listing.list_amendments(t.amendments(paid=True), t.legislators, PAGE))


@query(
    "l2_list_amendments_page_3",
    on_views("amendments", f"SELECT {SEARCH_SQL}, {URLS_SQL} FROM amendments WHERE tipo_emenda ILIKE '%individual%' {BY_AMOUNT} LIMIT 50 OFFSET 100"),
)
def _(t):
    found = listing.list_amendments(t.amendments(paid=True), t.legislators, {"tipo_emenda": "individual"}, page=3, page_size=50)
    return plain_money(found)


@query("l2_list_amendments_total", on_views("amendments", "SELECT count(*) AS total FROM amendments WHERE ano = 1998 AND partido_autor = 'BUILDING'"))
def _(t):
    return listing.count_amendments(t.amendments(), t.legislators, PAGE)


@query(
    "l3_list_legislators",
    on_views("legislators", "SELECT * FROM legislators WHERE nome ILIKE '%9%' AND partido = 'HOUSEHOLD' ORDER BY nome, cod_autor LIMIT 25 OFFSET 25"),
)
def _(t):
    return listing.list_legislators(t.legislators, nome="9", partido="household", page=2, page_size=25)


@query("l3_list_legislators_total", on_views("legislators", "SELECT count(*) AS total FROM legislators WHERE nome ILIKE '%9%' AND uf = 'NATION_3'"))
def _(t):
    return listing.count_legislators(t.legislators, nome="9", uf="nation_3")


@query(
    "l4_sort_by_text",
    on_views("amendments", "SELECT id, nome_autor, CASE WHEN ano > 1996 THEN uf END AS uf FROM amendments ORDER BY coalesce(CASE WHEN ano > 1996 THEN uf END, ''), id LIMIT 20 OFFSET 4000"),
)
def _(t):
    rows = t.amendments().withColumn("uf", F.when(F.col("ano") > 1996, F.col("uf")))
    return listing.sort_by(rows, "uf", ascending=True, page=200).select("id", "nome_autor", "uf")


@query("l4_sort_by_amount", on_views("amendments", "SELECT id, valor_pago::DOUBLE AS valor_pago FROM amendments ORDER BY valor_pago DESC, id LIMIT 20 OFFSET 20"))
def _(t):
    return plain_money(listing.sort_by(t.amendments(author=False, paid=True), "valor_pago", page=1).select("id", "valor_pago"))


@query("a1_total_count", on_views("amendments", "SELECT count(*) AS total FROM amendments WHERE ano BETWEEN 1996 AND 1999 AND funcao = '02'"))
def _(t):
    return agg.total_count(filters.dynamic_filter(t.amendments(author=False), {"ano_inicio": 1996, "ano_fim": 1999, "funcao": "02"}))


@query("a2_distinct_authors", on_views("amendments", "SELECT DISTINCT nome_autor FROM amendments"))
def _(t):
    return agg.distinct_authors(t.amendments())


def _usd(column: str) -> str:
    return f"format('R$ {{:,.2f}}', {column}::DOUBLE)"


@query(
    "a3_per_year",
    on_views("amendments", f"""SELECT ano, count(*) AS qtd, sum(valor_empenhado)::DOUBLE AS empenhado,
        {_usd('sum(valor_empenhado)')} AS empenhado_texto FROM amendments GROUP BY ano"""),
)
def _(t):
    return plain_money(agg.per_year(t.amendments(author=False)))


@query(
    "a4_author_by_function",
    on_views("amendments", f"""SELECT nome_autor, funcao_nome, count(*) AS qtd, sum(valor_empenhado)::DOUBLE AS empenhado, sum(valor_pago)::DOUBLE AS pago,
        {_usd('sum(valor_empenhado)')} AS empenhado_texto, {_usd('sum(valor_pago)')} AS pago_texto
        FROM amendments WHERE funcao_nome ILIKE '%u_gen%' GROUP BY nome_autor, funcao_nome"""),
)
def _(t):
    rows = t.amendments(paid=True).filter(p.like_ignoring_case("funcao_nome", "%u_gen%"))
    return plain_money(agg.author_by_function(rows))


def _top_sql(condition: str) -> str:
    return on_views("amendments", f"""SELECT nome_autor, count(*) AS qtd, sum(valor_empenhado)::DOUBLE AS empenhado, {_usd('sum(valor_empenhado)')} AS empenhado_texto
        FROM amendments WHERE {condition} GROUP BY nome_autor ORDER BY sum(valor_empenhado) DESC, nome_autor LIMIT 5""")


@query("a5_top_authors_of_year", _top_sql("funcao_nome ILIKE '%medi%' AND ano = 1999"))
def _(t):
    rows = t.amendments().filter(p.all_of(p.like_ignoring_case("funcao_nome", "%medi%"), p.equals("ano", 1999)))
    return plain_money(agg.top_authors(rows))


@query("a6_top_authors_of_range", _top_sql("ano BETWEEN 1996 AND 2000"))
def _(t):
    return plain_money(agg.top_authors(t.amendments().filter(p.between("ano", 1996, 2000))))


STATS_SQL = """round(avg(latencia_ms), 2) AS media_ms, round(stddev_pop(latencia_ms), 2) AS desvio_padrao_ms,
    min(latencia_ms) AS min_ms, max(latencia_ms) AS max_ms, count(latencia_ms) AS n_execucoes"""


@query("a7_latency_stats", on_views("question_log", f"SELECT modo_busca, {STATS_SQL} FROM question_log GROUP BY 1"))
def _(t):
    return agg.latency_stats(t.question_log, "modo_busca")


@query(
    "a9_class_report",
    """SELECT upper(substr(event_type, 1, 1)) AS tipo, count(*) AS total, count(*) FILTER (event_type <> 'error') AS sucessos,
        round(coalesce(avg((user_id % 5) / 4.0) FILTER (event_type <> 'error'), 0), 4) AS precisao,
        round(coalesce(avg(CAST(round(value) AS INTEGER)) FILTER (event_type <> 'error'), 0), 4) AS latencia_media_ms FROM events GROUP BY 1""",
)
def _(t):
    results = t.table("events").select(
        F.concat(F.upper(F.substring("event_type", 1, 1)), "event_id").alias("id"),
        ((F.col("user_id") % 5) / 4.0).alias("precisao_entidades"),
        F.round("value").cast("int").alias("latencia_ms"),
        (F.col("event_type") != "error").alias("sucesso"),
    )
    return agg.class_report(results)


@query("o1_total", on_views("amendments", "SELECT sum(valor_empenhado)::DOUBLE AS valor, count(*) AS qtd FROM amendments WHERE uf = 'NATION_9' AND ano = 1996"))
def _(t):
    return plain_money(agg.total(filters.dynamic_filter(t.amendments(), {"uf": "NATION_9", "ano": 1996})))


def _rank_sql(by: str, n: int, condition: str = "TRUE") -> str:
    return on_views("amendments", f"""SELECT {by}, sum(valor_empenhado)::DOUBLE AS valor, count(*) AS qtd FROM amendments WHERE {condition}
        GROUP BY 1 ORDER BY sum(valor_empenhado) DESC, 1 LIMIT {n}""")


@query("o2_ranking_authors", _rank_sql("nome_autor", 10, "ano = 2000"))
def _(t):
    return plain_money(agg.ranking(filters.dynamic_filter(t.amendments(), {"ano": 2000}), "nome_autor", n=10))


@query("o2_ranking_parties", _rank_sql("partido_autor AS partido", 3, "funcao = '04'"))
def _(t):
    return plain_money(agg.ranking(filters.filter_with_party(t.amendments(author=False), t.legislators, {"funcao": "04"}), "partido", n=3))


@query("o2_ranking_states", _rank_sql("uf", 5))
def _(t):
    return plain_money(agg.ranking(t.amendments(), "uf", n=5))


@query(
    "o2_ranking_within_state",
    on_views("amendments", """SELECT * FROM (SELECT uf, nome_autor, sum(valor_empenhado)::DOUBLE AS valor, count(*) AS qtd,
        CAST(rank() OVER (PARTITION BY uf ORDER BY sum(valor_empenhado) DESC) AS INTEGER) AS posicao FROM amendments GROUP BY uf, nome_autor) WHERE posicao <= 3"""),
)
def _(t):
    return plain_money(agg.ranking_within(t.amendments(), "uf", "nome_autor"))


@query("o3_mean", on_views("amendments", "SELECT round(sum(valor_empenhado)::DOUBLE / count(*), 2) AS media, count(*) AS qtd FROM amendments WHERE tipo_emenda = 'Individual'"))
def _(t):
    return plain_money(agg.mean(filters.dynamic_filter(t.amendments(author=False), {"tipo_emenda": "individual"})))


@query("o4_count_distinct", on_views("amendments", "SELECT count(DISTINCT nome_autor) AS distintos FROM amendments WHERE ano = 2001"))
def _(t):
    return agg.count_distinct(filters.dynamic_filter(t.amendments(), {"ano": 2001}))


@query("o4_count_distinct_approximate", on_views("amendments", "SELECT count(DISTINCT nome_autor) AS distintos, true AS dentro FROM amendments WHERE ano = 2001"))
def _(t):
    """The approximate count lies within twice its stated error of the exact one."""
    rows = filters.dynamic_filter(t.amendments(), {"ano": 2001})
    counted = rows.agg(F.countDistinct("nome_autor").alias("distintos"), F.approx_count_distinct("nome_autor").alias("perto"))
    return counted.select("distintos", (F.abs(F.col("perto") - F.col("distintos")) <= 0.1 * F.col("distintos")).alias("dentro"))


def _compare_sql(dimension: str, values: list[str]) -> str:
    sums = ", ".join(f"coalesce(sum(valor_empenhado) FILTER ({dimension} = '{v}'), 0)::DOUBLE AS \"{v}\"" for v in values)
    listed = ", ".join(f"'{v}'" for v in values)
    return on_views("amendments", f"SELECT ano, {sums} FROM amendments WHERE {dimension} IN ({listed}) GROUP BY ano")


@query("o5_compare_parties", _compare_sql("partido_autor", ["BUILDING", "MACHINERY"]))
def _(t):
    rows = filters.with_party(t.amendments(author=False), t.legislators)
    return plain_money(agg.compare(rows, "partido", ["BUILDING", "MACHINERY"]))


@query("o5_compare_types", _compare_sql("tipo_emenda", ["Bancada", "Individual"]))
def _(t):
    return plain_money(agg.compare(t.amendments(author=False), "tipo_emenda", ["Bancada", "Individual"]))


@query(
    "o5_compare_regions",
    on_views("amendments regions", """SELECT ano, coalesce(sum(valor_empenhado) FILTER (nome = 'africa'), 0)::DOUBLE AS africa,
        coalesce(sum(valor_empenhado) FILTER (nome = 'asia'), 0)::DOUBLE AS asia
        FROM amendments JOIN (SELECT nome, unnest(ufs) AS uf FROM regions) r USING (uf) WHERE nome IN ('africa', 'asia') GROUP BY ano"""),
)
def _(t):
    states = t.regions.select(F.col("nome").alias("regiao"), F.explode("ufs").alias("uf"))
    return plain_money(agg.compare(t.amendments().join(states, "uf"), "regiao", ["africa", "asia"]))


def _trend_sql(group: str) -> str:
    by = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return on_views("amendments", f"""SELECT {by}ano, valor::DOUBLE AS valor,
        coalesce((valor - lag(valor) OVER (w))::DOUBLE, 0) AS variacao_anterior, (valor - first_value(valor) OVER (w))::DOUBLE AS variacao_inicial
        FROM (SELECT {by}ano, sum(valor_empenhado) AS valor FROM amendments GROUP BY {by}ano) WINDOW w AS ({part}ORDER BY ano)""")


def _trend(df):
    return plain_money(df).withColumn("variacao_anterior", F.coalesce("variacao_anterior", F.lit(0.0)))


@query("o6_trend", _trend_sql(""))
def _(t):
    return _trend(agg.trend(t.amendments(author=False)))


@query("o6_trend_by_function", _trend_sql("funcao_nome"))
def _(t):
    return _trend(agg.trend(t.amendments(author=False), "funcao_nome"))


@query(
    "o7_growth_ranking",
    on_views("amendments", """SELECT subfuncao_nome, coalesce(sum(valor_empenhado) FILTER (ano = 1996), 0)::DOUBLE AS valor_inicial,
        coalesce(sum(valor_empenhado) FILTER (ano = 2000), 0)::DOUBLE AS valor_final,
        (coalesce(sum(valor_empenhado) FILTER (ano = 2000), 0) - coalesce(sum(valor_empenhado) FILTER (ano = 1996), 0))::DOUBLE AS crescimento
        FROM amendments WHERE ano IN (1996, 2000) GROUP BY 1"""),
)
def _(t):
    return plain_money(agg.growth_ranking(t.amendments(author=False), "subfuncao_nome", 1996, 2000))


@query(
    "o8_ratio",
    on_views("amendments", """SELECT ano, sum(valor_empenhado)::DOUBLE AS empenhado, sum(valor_pago)::DOUBLE AS pago,
        round(sum(valor_pago)::DOUBLE / nullif(sum(valor_empenhado)::DOUBLE, 0), 6) AS proporcao FROM amendments GROUP BY ano"""),
)
def _(t):
    return plain_money(agg.ratio(t.amendments(author=False, paid=True), "ano"))


@query("o9_list_distinct", on_views("amendments", "SELECT DISTINCT nome_autor FROM amendments WHERE uf = 'NATION_2' AND ano = 1997"))
def _(t):
    return agg.list_distinct(filters.dynamic_filter(t.amendments(), {"uf": "NATION_2", "ano": 1997}))


@query("p1_source_url", on_views("amendments", """SELECT id, CASE WHEN id % 3 > 0 THEN 'https://portaldatransparencia.gov.br/emendas/detalhe?codigoEmenda=' || codigo_emenda
    ELSE 'https://portaldatransparencia.gov.br/emendas/consulta' END AS source_url FROM amendments"""))
def _(t):
    code = F.when(F.col("id") % 3 == 1, F.col("codigo_emenda")).when(F.col("id") % 3 == 0, F.lit(""))
    code = F.when(F.col("id") % 3 == 2, F.col("codigo_emenda")).otherwise(code)
    return t.amendments(author=False).select("id", links.source_url(code).alias("source_url"))


@query("p2_legislator_url", on_views("amendments", "SELECT id, coalesce(CASE WHEN id % 4 > 0 AND cod_autor <> 0 THEN 'https://www.camara.leg.br/deputados/' || cod_autor END, 'sem') AS parlamentar_url FROM amendments"))
def _(t):
    author = F.when(F.col("id") % 4 > 0, F.col("cod_autor"))
    url = F.coalesce(links.legislator_url(author), F.lit("sem"))
    return t.amendments(author=False).select("id", url.alias("parlamentar_url"))


@query("p3_enrich", on_views("amendments", f"SELECT id, {URLS_SQL} FROM amendments"))
def _(t):
    return present.enrich(t.amendments(author=False)).select("id", "source_url", "parlamentar_url")


def _marks(column: str) -> str:
    return f"translate(format('{{:,.2f}}', {column}::DOUBLE), ',.', '.,')"


@query(
    "p6_format_brl",
    f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'R$ 0,00' WHEN c_acctbal < 0 THEN '-R$ ' || {_marks('-c_acctbal')}
        ELSE 'R$ ' || {_marks('c_acctbal')} END AS texto FROM customer""",
)
def _(t):
    amount = F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal").cast(money.AMOUNT))
    return t.table("customer").select(F.col("c_custkey").alias("id"), money.format_brl(amount).alias("texto"))


@query("p7_format_date", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'em ' || year(o_orderdate)
    ELSE strftime(o_orderdate, '%d/%m/%Y') END AS data FROM orders""")
def _(t):
    k, day = F.col("o_orderkey") % 9, F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = (
        F.when(k == 1, F.concat(F.lit("em "), F.year("o_orderdate")))
        .when(k.isin(2, 3), F.concat(day, F.lit("T10:30:00")))
        .when(k > 0, day)
    )
    return t.table("orders").select(F.col("o_orderkey").alias("id"), text.format_date(shown).alias("data"))


@query("p8_format_percent", f"SELECT l_orderkey, l_linenumber, {_marks('(l_discount * 100)')} || '%' AS desconto, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    shown = money.format_percent(F.col("l_discount")).alias("desconto")
    return t.table("lineitem").select("l_orderkey", "l_linenumber", shown).groupBy("l_orderkey", "l_linenumber", "desconto").agg(F.count("*").alias("n"))


@query("p9_format_usd_style", on_views("amendments", f"SELECT id, {_usd('valor_empenhado')} AS texto FROM amendments"))
def _(t):
    return t.amendments(author=False).select("id", money.format_usd_style(F.col("valor_empenhado")).alias("texto"))


@query(
    "g1_append_log",
    """SELECT 'pergunta ' || event_id AS consulta_nl, '{"ano":"' || (1995 + event_id % 7) || '"}' AS entidades_json, event_type AS modo_busca,
       CAST(event_id % 21 AS INTEGER) AS num_resultados, CAST(round(value) AS INTEGER) AS latencia_ms, true AS sucesso, count(*) AS linhas FROM events GROUP BY ALL""",
)
def _(t):
    """Two appends; the second one lands next to the first."""
    from erario import schemas
    from erario.sources import writers

    path = writers.scratch_path(t.spark, "log")
    answered = t.table("events").select(
        "event_id",
        F.concat(F.lit("pergunta "), "event_id").alias("consulta"),
        F.create_map(F.lit("ano"), (F.col("event_id") % 7 + 1995).cast("string")).alias("entidades"),
        F.col("event_type").alias("modo"),
        (F.col("event_id") % 21).alias("num_resultados"),
        F.round("value").alias("latencia_ms"),
    )
    for part in (F.col("event_type") == "view", F.col("event_type") != "view"):
        writers.append_log(question_log.log_rows(answered.filter(part)), path)
    stored = t.spark.read.schema(schemas.QUESTION_LOG).parquet(path)
    shown = ["consulta_nl", "entidades_json", "modo_busca", "num_resultados", "latencia_ms", "sucesso"]
    return stored.groupBy(*shown).agg(F.count("*").alias("linhas"))


@query(
    "g2_log_summary",
    on_views("question_log", f"SELECT strftime(created_at, '%Y-%m-%d') AS dia, modo_busca, {STATS_SQL} FROM question_log GROUP BY 1, 2"),
)
def _(t):
    return question_log.log_summary(t.question_log).withColumn("dia", F.date_format("dia", "yyyy-MM-dd"))


@query(
    "g2_log_summary_of_range",
    on_views("question_log", f"""SELECT strftime(created_at, '%Y-%m-%d') AS dia, modo_busca, {STATS_SQL} FROM question_log
        WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12' GROUP BY 1, 2"""),
)
def _(t):
    rows = question_log.log_summary(t.question_log, "2024-01-05", "2024-01-12")
    return rows.withColumn("dia", F.date_format("dia", "yyyy-MM-dd"))


COMMANDS = ["SELECT", "Insert", "UPDATE", "delete", "DROP", "ALTER", "truncate"]


@query(
    "g3_screen_sql",
    """SELECT event_id AS id, coalesce(nullif(lower(cmd), 'select'), '') AS comando_proibido, cmd = 'SELECT' AS sql_permitida
       FROM (SELECT event_id, (['SELECT', 'Insert', 'UPDATE', 'delete', 'DROP', 'ALTER', 'truncate'])[event_id % 7 + 1] AS cmd FROM events)""",
)
def _(t):
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % 7 + 1).cast("int"))
    log = t.table("events").select(F.col("event_id").alias("id"), F.concat(command, F.lit(" x FROM emendas WHERE id = "), "event_id").alias("sql_gerada"))
    shown = question_log.screen_sql(log)
    return shown.select("id", F.coalesce("comando_proibido", F.lit("")).alias("comando_proibido"), "sql_permitida")
