"""Registered queries: embeddings, vector and hybrid search, questions, evaluation."""

from pyspark.sql import Column, DataFrame, functions as F

from erario.functions import dictionary, similarity, text
from erario.functions.fixed_values import (
    AMENDMENT_TYPE_TERMS,
    FUNCTION_TERMS,
    OPERATION_TERMS,
    REGION_STATES,
    STATE_CODES,
    SUBFUNCTION_TERMS,
)
from erario.operators import aggregates, keywords, present, questions as q, vectors as v
from erario.operators.filters import with_party
from erario.plans.registry import query
from erario.plans.views import Tables, on_views, plain_money
from erario.sources import writers

DIM = 64


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def _sql_map(pairs: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f"'{k}': '{x}'" for k, x in pairs.items())}}}"


# --- embeddings ---------------------------------------------------------------------------------

TEXT_SQL = """nome_autor || ' | ' || funcao_nome || CASE WHEN ano > 1996 THEN ' | ' || subfuncao_nome ELSE '' END
    || CASE WHEN ano % 2 = 0 THEN ' | ' || tipo_emenda ELSE '' END || ' | UF: ' || CASE WHEN ano = 1999 THEN 'None' ELSE uf END || ' | Ano: ' || ano"""


def _with_text(t: Tables) -> DataFrame:
    rows = t.amendments()
    composed = text.amendment_text(
        F.col("nome_autor"),
        F.col("funcao_nome"),
        F.when(F.col("ano") > 1996, F.col("subfuncao_nome")),
        F.when(F.col("ano") % 2 == 0, F.col("tipo_emenda")).otherwise(F.lit("  ")),
        F.when(F.col("ano") != 1999, F.col("uf")),
        F.col("ano"),
    )
    return rows.withColumn("texto", composed)


@query("v1_compose_text", on_views("amendments", f"SELECT id, {TEXT_SQL} AS texto FROM amendments"))
def _(t):
    return _with_text(t).select("id", "texto")


@query("v1_compose_text_short", on_views("amendments", "SELECT id, nome_autor || ' | ' || funcao_nome || ' | ' || subfuncao_nome || ' | ' || localidade || ' | Ano: ' || ano AS texto FROM amendments"))
def _(t):
    parts = [F.col(c) for c in ("nome_autor", "funcao_nome", "subfuncao_nome", "localidade", "ano")]
    return t.amendments().select("id", text.amendment_text_short(*parts).alias("texto"))


@query("v2_compose_classification_text", on_views("classification", "SELECT id, funcao_nome || ' ' || subfuncao_nome || ' ' || programa_nome || ' None' AS texto FROM classification"))
def _(t):
    composed = text.classification_text(F.col("funcao_nome"), F.col("subfuncao_nome"), F.col("programa_nome"), F.lit(None).cast("string"))
    return t.classification.select("id", composed.alias("texto"))


def _partly_embedded(t: Tables) -> DataFrame:
    stored = t.vectors.select("id", "embedding")
    return t.amendments(author=False).select("id", "ano").join(stored, "id", "left")


@query("v3_pending", on_views("amendments vectors", "SELECT id, ano FROM amendments WHERE id NOT IN (SELECT id FROM vectors)"))
def _(t):
    return v.pending(_partly_embedded(t)).select("id", "ano")


@query("v3_pending_by_key", on_views("amendments vectors", "SELECT id, ano FROM amendments WHERE id NOT IN (SELECT id FROM vectors)"))
def _(t):
    return v.pending_by_key(t.amendments(author=False), t.vectors).select("id", "ano")


@query("v4_embed", on_views("amendments", f"SELECT id, {TEXT_SQL} AS texto, 384 AS dimensoes, 1.0::DOUBLE AS comprimento FROM amendments"))
def _(t):
    """Every text gets a 384-d vector of length one."""
    embedded = v.embed(_with_text(t).select("id", "texto"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return embedded.select("id", "texto", F.size("embedding").alias("dimensoes"), F.round(F.sqrt(squares), 4).alias("comprimento"))


def letter_counts():
    """A stand-in encoder: counts of the letters a to z."""
    import numpy as np

    return lambda texts: np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts])


LETTERS = ", ".join(f"length(texto) - length(replace(texto, '{chr(97 + i)}', ''))" for i in range(26))


@query(
    "v4_embed_plugged_encoder",
    f"""WITH x AS (SELECT doc_id, lower(text) AS texto FROM documents), c AS (SELECT doc_id, [{LETTERS}]::DOUBLE[] AS n FROM x)
        SELECT doc_id, round(n[5] / sqrt(list_dot_product(n, n)), 4) AS letra_e, 26 AS dimensoes FROM c""",
)
def _(t):
    rows = t.table("documents").select("doc_id", F.lower("text").alias("texto"))
    embedded = v.embed(rows, encoder=letter_counts)
    return embedded.select("doc_id", F.round(F.col("embedding")[4].cast("double"), 4).alias("letra_e"), F.size("embedding").alias("dimensoes"))


@query(
    "v5_write_back",
    on_views("amendments vectors", """SELECT a.id, CASE WHEN v.id IS NOT NULL AND a.id % 2 = 0 THEN round(v.embedding[1], 6)
        WHEN a.id % 3 = 0 THEN round(a.ano::DOUBLE, 6) WHEN v.id IS NOT NULL THEN -1 ELSE -1 END AS primeira
        FROM amendments a LEFT JOIN vectors v ON v.id = a.id"""),
)
def _(t):
    """Even ids below the vector count keep their vector; the rest is filled where a new one exists."""
    rows = _partly_embedded(t).withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")))
    fresh = rows.filter(F.col("id") % 3 == 0).select("id", F.array(F.col("ano").cast("float")).alias("embedding"))
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return v.write_back(rows, fresh).select("id", F.coalesce(first, F.lit(-1.0)).alias("primeira"))


@query(
    "v6_cosine",
    on_views("vectors centroids", """SELECT id, round(list_cosine_similarity(v.embedding, c.embedding), 4) AS similaridade,
        round(1 - list_cosine_similarity(v.embedding, c.embedding), 4) AS distancia FROM vectors v JOIN centroids c ON v.label = c.id_consulta"""),
)
def _(t):
    centre = v.group_centroids(t.vectors, "label").withColumnRenamed("embedding", "centro")
    rows = t.vectors.join(centre, "label")
    a, b = F.col("embedding"), F.col("centro")
    return rows.select("id", F.round(similarity.cosine(a, b), 4).alias("similaridade"), F.round(similarity.cosine_distance(a, b), 4).alias("distancia"))


# --- vector search: one question per label, asking for its centroid ------------------------------


def _asked(t: Tables) -> DataFrame:
    return v.group_centroids(t.vectors, "label").withColumnRenamed("label", "id_consulta")


def _corpus(t: Tables) -> DataFrame:
    return t.vectors.select("id", "embedding")


PAIRS = "SELECT c.id_consulta, v.id, round(list_cosine_similarity(c.embedding, v.embedding), 9) AS s FROM centroids c, vectors v"
CUT = "SELECT *, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY s DESC, id) AS INTEGER) AS posicao FROM pairs"


def _topk_sql(shown: str, k: int, condition: str = "TRUE", tail: str = "", views: str = "vectors centroids", **more) -> str:
    return on_views(
        views, f"SELECT {shown} FROM ranked {tail} WHERE posicao <= {k}", pairs=f"SELECT * FROM ({PAIRS}) WHERE {condition}", ranked=CUT, **more
    )


@query(
    "v7_semantic_topk",
    _topk_sql(
        "id_consulta, ranked.id, round(s, 4) AS similaridade, posicao, codigo_emenda, ano, partido_autor AS partido",
        20, "s >= 0.2", "JOIN amendments a ON a.id = ranked.id", "vectors centroids amendments",
    ),
)
def _(t):
    found = v.semantic_topk(_asked(t), _corpus(t), k=20, threshold=0.2)
    rows = with_party(v.with_attributes(found, t.amendments(author=False)), t.legislators)
    return rows.select("id_consulta", "id", F.round("similaridade", 4).alias("similaridade"), "posicao", "codigo_emenda", "ano", "partido")


@query("v7_semantic_topk_default", _topk_sql("id_consulta, id, round(s, 4) AS similaridade, posicao", 20, "s >= 0.45"))
def _(t):
    found = v.semantic_topk(_asked(t), _corpus(t))
    return found.withColumn("similaridade", F.round("similaridade", 4))


@query(
    "v8_semantic_topk_report",
    _topk_sql("id_consulta, ranked.id, round(s, 4) AS similaridade, posicao, substr(texto, 1, 200) AS texto", 5, tail="JOIN texts x ON x.id = ranked.id",
              views="vectors centroids", texts="SELECT doc_id AS id, text AS texto FROM documents"),
)
def _(t):
    texts = t.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))
    found = v.semantic_topk(_asked(t), _corpus(t), k=5, threshold=None)
    return v.rounded_texts(found, texts).select("id_consulta", "id", "similaridade", "posicao", "texto")


@query(
    "v9_nearest_classification",
    on_views("vectors centroids", """SELECT id_consulta, round(s, 4) AS similaridade, CASE WHEN s >= 0.47 THEN 'F' || (id % 7) ELSE '' END AS funcao
        FROM ranked WHERE posicao = 1""", pairs=PAIRS, ranked=CUT),
)
def _(t):
    stored = _corpus(t).withColumn("funcao", F.concat(F.lit("F"), F.col("id") % 7))
    found = v.nearest_classification(_asked(t), stored, threshold=0.47)
    return found.select("id_consulta", F.round("similaridade", 4).alias("similaridade"), F.coalesce("funcao", F.lit("")).alias("funcao"))


@query(
    "v10_hybrid_prefilter",
    _topk_sql("id_consulta, id, round(s, 4) AS similaridade, posicao", 5, "id IN (SELECT id FROM amendments WHERE ano = 1998)", views="vectors centroids amendments"),
)
def _(t):
    selected = t.amendments(author=False).filter("ano = 1998")
    return v.hybrid_prefilter(_asked(t), _corpus(t), selected).withColumn("similaridade", F.round("similaridade", 4))


@query(
    "v10_hybrid_prefilter_per_question",
    on_views(
        "vectors centroids amendments", "SELECT id_consulta, id, round(s, 4) AS similaridade, posicao FROM ranked WHERE posicao <= 5",
        pairs=f"SELECT p.* FROM ({PAIRS}) p JOIN amendments a ON a.id = p.id WHERE a.ano IN (1995 + id_consulta % 7, 1995 + (id_consulta + 2) % 7)", ranked=CUT,
    ),
)
def _(t):
    """Every question ranks only the rows of its own two years."""
    years = t.amendments(author=False).select("id", F.col("ano").alias("chave"))
    label = F.col("id_consulta")
    asked = _asked(t).withColumn("chaves", F.array((label % 7 + 1995).cast("int"), ((label + 2) % 7 + 1995).cast("int")))
    return v.semantic_topk(asked, _corpus(t).join(years, "id"), 5, threshold=None).withColumn("similaridade", F.round("similaridade", 4))


def _label_filters(t: Tables) -> DataFrame:
    """Filters per label: even labels ask for a whole year, odd ones for few rows."""
    label = F.col("label")
    odd = label % 2 == 1
    return t.vectors.select("label").distinct().select(
        label.alias("id_consulta"),
        (label % 7 + 1995).cast("int").alias("ano"),
        F.when(odd, F.concat(F.lit("NATION_"), label)).alias("uf"),
        F.when(odd, F.concat(F.lit("0"), label % 5 + 1)).alias("funcao"),
    )


FILL_STRUCTURED = """SELECT id_consulta, id, posicao FROM (SELECT l.label AS id_consulta, a.id,
    row_number() OVER (PARTITION BY l.label ORDER BY valor_empenhado DESC, a.id) AS posicao FROM (SELECT DISTINCT label FROM vectors) l JOIN amendments a
    ON a.ano = l.label % 7 + 1995 AND (l.label % 2 = 0 OR (a.uf = 'NATION_' || l.label AND a.funcao = '0' || (l.label % 5 + 1)))) WHERE posicao <= 20"""


@query(
    "v11_hybrid_fill",
    on_views(
        "vectors centroids amendments",
        """SELECT id_consulta, id, origem, similaridade, posicao FROM (SELECT id_consulta, id, CASE fonte WHEN 0 THEN 'sql' ELSE 'vetorial' END AS origem,
           coalesce(round(s, 4), -1) AS similaridade, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY fonte, posicao) AS INTEGER) AS posicao FROM (
           SELECT id_consulta, id, 0 AS fonte, posicao, NULL AS s FROM structured UNION ALL
           SELECT id_consulta, id, 1, posicao, s FROM ranked r WHERE posicao <= 20 AND (id_consulta, id) NOT IN (SELECT id_consulta, id FROM structured)
           AND id_consulta NOT IN (SELECT id_consulta FROM structured GROUP BY 1 HAVING count(*) >= 20))) WHERE posicao <= 20""",
        pairs=f"SELECT * FROM ({PAIRS}) WHERE s >= 0.2", ranked=CUT, structured=FILL_STRUCTURED,
    ),
)
def _(t):
    ranked = q.structured_ranks(_label_filters(t), t.amendments(), t.legislators)
    structured = writers.written(ranked, "estruturadas")
    found = v.hybrid_fill(structured, _asked(t), _corpus(t), threshold=0.2)
    return found.withColumn("similaridade", F.coalesce(F.round("similaridade", 4), F.lit(-1.0)))


BITS, RADIUS = 6, 2
CODE = " + ".join(
    f"(CASE WHEN list_dot_product(embedding, {[float(x) for x in plane]}::DOUBLE[]) > 0 THEN {1 << i} ELSE 0 END)"
    for i, plane in enumerate(v.hyperplanes(BITS, DIM))
)
NEAR_PAIRS = f"""SELECT p.id_consulta, p.id, s FROM ({PAIRS}) p JOIN (SELECT id, {CODE} AS celula FROM vectors) a ON a.id = p.id
    JOIN (SELECT id_consulta, {CODE} AS celula FROM centroids) b ON b.id_consulta = p.id_consulta WHERE bit_count(xor(a.celula, b.celula)) <= {RADIUS}"""


@query(
    "v12_approximate_topk",
    on_views("vectors centroids", "SELECT id_consulta, id, round(s, 4) AS similaridade, posicao FROM ranked WHERE posicao <= 20", pairs=NEAR_PAIRS, ranked=CUT),
)
def _(t):
    """Cells are written out as partitions once; the search then reads only the cells near its questions."""
    path = writers.scratch_path(t.spark, "celulas")
    cells = v.with_cells(_corpus(t), BITS, DIM)
    writers.write_table(cells, path, partition_by="chave")
    stored = t.spark.read.schema(cells.schema).parquet(path)
    found = v.approximate_topk(_asked(t), stored, BITS, DIM, RADIUS, threshold=None)
    return found.withColumn("similaridade", F.round("similaridade", 4))


@query(
    "v12_approximate_recall",
    on_views(
        "vectors centroids",
        """SELECT e.id_consulta, count(*) AS exatas, count(n.id) AS achadas, round(count(n.id) / count(*), 4) AS revocacao
           FROM exact e LEFT JOIN near n ON n.id_consulta = e.id_consulta AND n.id = e.id GROUP BY 1""",
        all_pairs=PAIRS, near_pairs=NEAR_PAIRS,
        exact=f"SELECT * FROM ({CUT.replace('pairs', 'all_pairs')}) WHERE posicao <= 20",
        near=f"SELECT * FROM ({CUT.replace('pairs', 'near_pairs')}) WHERE posicao <= 20",
    ),
)
def _(t):
    asked, corpus = writers.written(_asked(t), "perguntas"), _corpus(t)
    near = v.approximate_topk(asked, v.with_cells(corpus, BITS, DIM), BITS, DIM, RADIUS, threshold=None)
    return v.recall(near, v.semantic_topk(asked, corpus, threshold=None))


WORDS_SQL = "SELECT DISTINCT {id}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS palavra FROM {table}"


@query(
    "v13_keyword_topk",
    f"""WITH asked AS ({WORDS_SQL.format(id='item_id AS id_consulta', table='benchmark')}), held AS ({WORDS_SQL.format(id='doc_id AS id', table='documents')}),
        counted AS (SELECT id_consulta, id, count(*) AS termos FROM asked JOIN held USING (palavra) WHERE palavra <> '' GROUP BY 1, 2)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY termos DESC, id) AS INTEGER) AS posicao FROM counted) WHERE posicao <= 20""",
)
def _(t):
    asked = t.table("benchmark").select(F.col("item_id").alias("id_consulta"), F.col("text").alias("texto"))
    corpus = t.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))
    return keywords.keyword_topk(asked, corpus)


@query(
    "v13_keyword_topk_amendments",
    on_views(
        "amendments",
        """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id_consulta ORDER BY termos DESC, id) AS INTEGER) AS posicao FROM (
           SELECT n_nationkey AS id_consulta, id, (funcao_nome = 'HIGH')::BIGINT + (contains(subfuncao_nome, 'T3'))::BIGINT
             + (split_part(nome_autor, '#', 2) = lpad(CAST(n_nationkey AS VARCHAR), 9, '0'))::BIGINT AS termos FROM nation, amendments) WHERE termos > 0) WHERE posicao <= 20""",
    ),
)
def _(t):
    number = F.lpad(F.col("n_nationkey").cast("string"), 9, "0")
    asked = t.table("nation").select(F.col("n_nationkey").alias("id_consulta"), F.concat_ws(" ", F.lit("high t3"), number).alias("texto"))
    rows = t.amendments()
    return keywords.keyword_topk(asked, rows.select("id", keywords.searchable_text(rows).alias("texto")))


# --- dictionary and decomposition ----------------------------------------------------------------

AREAS = list(dict.fromkeys([*SUBFUNCTION_TERMS, *FUNCTION_TERMS])) + ["ferrovia", "lixo urbano", "praia"]
PLACES = [*REGION_STATES, "Acre", "sp", "São Paulo", "Rj"]


def _terms(t: Tables) -> DataFrame:
    k = F.col("event_id")
    term = _pick(AREAS + PLACES, k % len(AREAS + PLACES))
    untidy = F.when(k % 2 == 1, F.upper(term)).otherwise(F.concat(F.lit(" "), term, F.lit("\t")))
    return t.table("events").select(F.col("event_id").alias("id"), untidy.alias("termo"))


def _term_sql(shown: str) -> str:
    return f"""WITH t AS (SELECT event_id AS id, {_sql_list(AREAS + PLACES)}[event_id % {len(AREAS + PLACES)} + 1] AS bruto, lower(bruto) AS termo FROM events),
        d AS (SELECT {_sql_map(FUNCTION_TERMS)} AS funcoes, {_sql_map(SUBFUNCTION_TERMS)} AS subfuncoes,
              {_sql_map({k: ','.join(x) for k, x in REGION_STATES.items()})} AS regioes)
        SELECT id, {shown} FROM t, d"""


@query("d1_resolve_function", _term_sql("coalesce(funcoes[termo], '') AS funcao, coalesce(subfuncoes[termo], '') AS subfuncao"))
def _(t):
    found = {"funcao": dictionary.resolve_function(F.col("termo")), "subfuncao": dictionary.resolve_subfunction(F.col("termo"))}
    return _terms(t).withColumns({c: F.coalesce(x, F.lit("")) for c, x in found.items()}).drop("termo")


@query("d2_resolve_area", _term_sql("coalesce(subfuncoes[termo], funcoes[termo], '') AS codigo"))
def _(t):
    return _terms(t).select("id", F.coalesce(dictionary.resolve_area(F.col("termo")), F.lit("")).alias("codigo"))


@query("d3_resolve_region", _term_sql("coalesce(regioes[termo], '') AS ufs"))
def _(t):
    states = F.array_join(dictionary.resolve_region(F.col("termo")), ",")
    return _terms(t).select("id", F.coalesce(states, F.lit("")).alias("ufs"))


@query("d4_resolve_uf", _term_sql("coalesce(regioes[termo], CASE WHEN id % 2 = 1 THEN upper(substr(bruto, 1, 2)) ELSE upper(' ' || substr(bruto, 1, 1)) END) AS ufs"))
def _(t):
    return _terms(t).select("id", F.array_join(dictionary.resolve_uf(F.col("termo")), ",").alias("ufs"))


def _entities(t: Tables) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id")
    values = {
        "ano": F.when(k % 3 == 0, (user % 7 + 1995).cast("string")),
        "ano_inicio": F.when(k % 3 == 1, (user % 3 + 1995).cast("string")),
        "ano_fim": F.when(k % 3 > 0, (user % 4 + 1998).cast("string")),
        "uf": F.when(k % 2 == 1, _pick(PLACES, k % len(PLACES))),
        "autor": F.when(k % 5 == 0, F.concat(F.lit("customer#"), user)),
        "partido": F.when(k % 7 == 0, F.lit("building")).otherwise(F.lit("")),
        "area": F.when(k % 4 < 3, F.concat(F.lit(" "), F.upper(_pick(AREAS, k % len(AREAS))))),
        "tipo_emenda": F.when(k % 6 == 0, F.lit("individual")),
        "operacao": F.when(k % 11 == 0, F.lit("total")),
    }
    entries = F.array(*[F.struct(F.lit(c).alias("k"), x.alias("v")) for c, x in values.items()])
    entities = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return t.table("events").select(k.alias("id_consulta"), entities.alias("entidades"))


DECOMPOSED_SQL = f"""WITH e AS (SELECT event_id AS k, user_id AS u, CASE WHEN event_id % 2 = 1 THEN {_sql_list(PLACES)}[event_id % {len(PLACES)} + 1] END AS lugar,
        CASE WHEN event_id % 4 < 3 THEN {_sql_list(AREAS)}[event_id % {len(AREAS)} + 1] END AS area FROM events),
    d AS (SELECT {_sql_map(FUNCTION_TERMS)} AS funcoes, {_sql_map(SUBFUNCTION_TERMS)} AS subfuncoes, {_sql_map({k: ','.join(x) for k, x in REGION_STATES.items()})} AS regioes),
    c AS (SELECT *, coalesce(subfuncoes[area], funcoes[area]) AS codigo FROM e, d)
    SELECT k AS id_consulta, CAST(CASE WHEN k % 3 = 0 THEN u % 7 + 1995 ELSE 0 END AS INTEGER) AS ano, CAST(CASE WHEN k % 3 = 1 THEN u % 3 + 1995 ELSE 0 END AS INTEGER) AS ano_inicio,
        CAST(CASE WHEN k % 3 = 1 THEN u % 4 + 1998 ELSE 0 END AS INTEGER) AS ano_fim,
        coalesce(CASE WHEN regioes[lugar] IS NULL THEN upper(substr(lugar, 1, 2)) END, '') AS uf, coalesce(regioes[lugar], '') AS ufs,
        CASE WHEN k % 5 = 0 THEN 'CUSTOMER#' || u ELSE '' END AS autor, CASE WHEN k % 7 = 0 THEN 'BUILDING' ELSE '' END AS partido,
        CASE WHEN length(codigo) <= 2 THEN codigo WHEN area = 'ferrovia' THEN '26' ELSE '' END AS funcao, CASE WHEN length(codigo) > 2 THEN codigo ELSE '' END AS subfuncao,
        CASE WHEN k % 6 = 0 THEN 'individual' ELSE '' END AS tipo_emenda, CASE WHEN codigo IS NULL AND area <> 'ferrovia' THEN area ELSE '' END AS termo_vetorial,
        CASE WHEN k % 11 = 0 THEN 'total' ELSE 'busca' END AS operacao FROM c"""


def _flat(df: DataFrame) -> DataFrame:
    """Nulls as '' or 0 and lists as text, the form results are compared in."""
    flat = df.withColumn("ufs", F.array_join("ufs", ",")) if "ufs" in df.columns else df
    return flat.na.fill("").na.fill(0)


@query("d5_decompose", DECOMPOSED_SQL)
def _(t):
    nearest = t.spark.createDataFrame([("ferrovia", "26"), ("praia", None)], "area string, funcao string")
    return _flat(q.decompose(_entities(t), nearest))


@query("d5_unresolved_areas", "SELECT unnest(['ferrovia', 'lixo urbano', 'praia']) AS area FROM (SELECT count(*) AS n FROM events) WHERE n > 1000")
def _(t):
    return q.unresolved_areas(_entities(t))


@query(
    "d6_parse_entities",
    """SELECT event_id AS id_consulta, CASE WHEN event_id % 6 < 3 THEN 'TEST ' || user_id ELSE '' END AS autor, CASE WHEN event_id % 6 < 3 THEN CAST(1995 + event_id % 7 AS VARCHAR) ELSE '' END AS ano,
       CASE WHEN event_id % 6 < 3 THEN '' ELSE 'pergunta ' || event_id END AS raw_query FROM events""",
)
def _(t):
    k = F.col("event_id")
    body = F.concat(F.lit('{"autor": "TEST '), "user_id", F.lit('",\n "ano": '), k % 7 + 1995, F.lit("}"))
    reply = (
        F.when(k % 6 == 0, F.concat(F.lit("Claro:\n```json\n"), body, F.lit("\n```\n{fim}")))
        .when(k % 6 == 1, body)
        .when(k % 6 == 2, F.concat(F.lit("Entidades: "), body, F.lit(" - pronto")))
        .when(k % 6 == 3, F.lit("no json"))
        .when(k % 6 == 4, F.concat(body, F.lit(" "), body))
        .otherwise(F.lit('{"autor": "TEST", }'))
    )
    replies = t.table("events").select(k.alias("id_consulta"), F.concat(F.lit("pergunta "), k).alias("consulta"), reply.alias("resposta"))
    parsed = q.parse_entities(replies)
    return _flat(parsed.select("id_consulta", *[F.try_element_at("entidades", F.lit(c)).alias(c) for c in ("autor", "ano", "raw_query")]))


def _cube_questions(t: Tables) -> DataFrame:
    """One question per filled combination of year, state, party and function, and per part of it."""
    axes = ["ano", "uf", "partido", "funcao"]
    found = with_party(t.amendments(), t.legislators).cube(*axes).agg(F.count("*").alias("linhas"))
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in axes])
    return found.select(name.alias("id_consulta"), *axes)


@query(
    "d7_answer_many",
    on_views(
        "amendments",
        """SELECT id_consulta, id, codigo_emenda, valor_empenhado::DOUBLE AS valor_empenhado, partido_autor AS partido, posicao FROM (
           SELECT p.id_consulta, a.*, CAST(row_number() OVER (PARTITION BY p.id_consulta ORDER BY valor_empenhado DESC, a.id) AS INTEGER) AS posicao
           FROM amendments a JOIN p ON (p.ano IS NULL OR p.ano = a.ano) AND (p.uf IS NULL OR p.uf = a.uf) AND (p.partido IS NULL OR p.partido = a.partido_autor)
           AND (p.funcao IS NULL OR p.funcao = a.funcao)) WHERE posicao <= 5""",
        p="""SELECT concat_ws('|', coalesce(CAST(ano AS VARCHAR), '*'), coalesce(uf, '*'), coalesce(partido_autor, '*'), coalesce(funcao, '*')) AS id_consulta,
             ano, uf, partido_autor AS partido, funcao FROM amendments GROUP BY CUBE (ano, uf, partido_autor, funcao)""",
    ),
)
def _(t):
    asked = writers.written(_cube_questions(t), "perguntas")
    rows = q.answer_many(asked, t.amendments(), t.legislators, k=5)
    return plain_money(rows.select("id_consulta", "id", "codigo_emenda", "valor_empenhado", "partido", "posicao"))


def _text_questions(t: Tables) -> DataFrame:
    """Per region and legislator party: region states, year range, author fragment and type."""
    parties = t.legislators.select("partido").distinct()
    asked = t.regions.select("nome", F.posexplode("ufs").alias("lugar", "uf"), "ufs")
    k = F.col("lugar")
    return asked.join(parties, F.length("partido") == F.col("lugar") + 6, "left").select(
        F.concat_ws("|", "nome", "uf", F.coalesce("partido", F.lit("*"))).alias("id_consulta"),
        F.when(k == 4, 1997).alias("ano"),
        F.when(k < 3, k + 1995).alias("ano_inicio"),
        F.when(k < 3, k + 1997).alias("ano_fim"),
        F.when(k % 2 == 0, F.col("uf")).alias("uf"),
        F.when(k % 2 == 1, F.col("ufs")).alias("ufs"),
        F.when(k != 1, F.concat(F.lit("0_"), k)).alias("autor"),
        "partido",
        F.when(k > 1, F.lit("individ")).alias("tipo_emenda"),
    )


@query(
    "d7_answer_text_filters",
    on_views(
        "amendments regions",
        """SELECT id_consulta, id, valor_empenhado::DOUBLE AS valor_empenhado, posicao FROM (
           SELECT p.id_consulta, a.*, CAST(row_number() OVER (PARTITION BY p.id_consulta ORDER BY valor_empenhado DESC, a.id) AS INTEGER) AS posicao
           FROM amendments a JOIN p ON (p.k <> 4 OR a.ano = 1997) AND (p.k >= 3 OR a.ano BETWEEN p.k + 1995 AND p.k + 1997)
           AND (CASE WHEN p.k % 2 = 0 THEN a.uf = p.uf ELSE list_contains(p.ufs, a.uf) END) AND (p.k = 1 OR a.nome_autor ILIKE '%0_' || p.k || '%')
           AND (p.partido IS NULL OR p.partido = a.partido_autor) AND (p.k <= 1 OR a.tipo_emenda ILIKE '%individ%')) WHERE posicao <= 20""",
        r="SELECT nome, ufs, unnest(ufs) AS uf, generate_subscripts(ufs, 1) - 1 AS k FROM regions",
        p="""SELECT r.*, x.partido, concat_ws('|', nome, uf, coalesce(x.partido, '*')) AS id_consulta FROM r
             LEFT JOIN (SELECT DISTINCT partido FROM legislators) x ON length(x.partido) = k + 6""",
    ),
)
def _(t):
    rows = q.answer_many(_text_questions(t), t.amendments(), t.legislators)
    return plain_money(rows.select("id_consulta", "id", "valor_empenhado", "posicao"))


@query(
    "d7_answer_summary",
    on_views(
        "amendments",
        """SELECT id_consulta, modo, CAST(count(a.id) AS INTEGER) AS num_resultados FROM p LEFT JOIN
           (SELECT *, row_number() OVER (PARTITION BY ano, uf, funcao ORDER BY id) AS r FROM amendments) a
           ON a.ano = p.ano AND a.uf = p.uf AND a.funcao = p.funcao AND r <= 20 GROUP BY 1, 2""",
        p="""SELECT y.ano || '|' || n_name || '|' || f.funcao AS id_consulta, y.ano, n_name AS uf, f.funcao, CASE WHEN f.funcao = '03' THEN 'hibrido' ELSE 'sql' END AS modo
             FROM (SELECT DISTINCT ano + 1 AS ano, uf AS n_name, funcao FROM amendments) y JOIN (SELECT DISTINCT funcao FROM amendments) f ON f.funcao = y.funcao""",
    ),
)
def _(t):
    seen = t.amendments().select((F.col("ano") + 1).alias("ano"), "uf", "funcao").distinct()
    asked = seen.select(
        F.concat_ws("|", "ano", "uf", "funcao").alias("id_consulta"), "ano", "uf", "funcao", F.when(F.col("funcao") == "03", F.lit("praia")).alias("termo_vetorial")
    )
    asked = writers.written(asked, "perguntas")
    return q.answer_summary(asked, q.structured_ranks(asked, t.amendments(), t.legislators))


ASKED_AREAS = list(FUNCTION_TERMS)
STATES = list(STATE_CODES)
TYPE_WORDS = list(AMENDMENT_TYPE_TERMS)
OPERATION_WORDS = list(OPERATION_TERMS)


@query(
    "d8_extract_entities",
    f"""WITH o AS (SELECT o_orderkey AS k, upper(c_name) AS nome, c_mktsegment AS partido FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT k AS id_consulta, CASE WHEN k % 3 = 0 THEN nome ELSE '' END AS autor, CASE WHEN k % 4 = 0 THEN partido ELSE '' END AS partido,
        CASE WHEN k % 5 = 0 THEN {_sql_list(list(REGION_STATES))}[k % 5 + 1] ELSE {_sql_list(list(STATE_CODES.values()))}[k % 27 + 1] END AS uf,
        {_sql_list(ASKED_AREAS)}[k % {len(ASKED_AREAS)} + 1] AS area, {_sql_list(list(AMENDMENT_TYPE_TERMS.values()))}[k % {len(TYPE_WORDS)} + 1] AS tipo_emenda,
        {_sql_list(list(OPERATION_TERMS.values()))}[k % {len(OPERATION_WORDS)} + 1] AS operacao, CAST(CASE WHEN k % 2 = 0 THEN 2000 + k % 20 ELSE 0 END AS INTEGER) AS ano,
        CAST(CASE WHEN k % 2 = 1 THEN 2000 + k % 20 ELSE 0 END AS INTEGER) AS ano_inicio, CAST(CASE WHEN k % 2 = 1 THEN 2021 ELSE 0 END AS INTEGER) AS ano_fim FROM o""",
)
def _(t):
    """Questions put together from the orders; the dictionary is the fixed one plus parties and names."""
    people = t.legislators.select(F.col("cod_autor").alias("o_custkey"), F.lower("nome").alias("nome"), "partido")
    rows, k = t.table("orders").join(people, "o_custkey"), F.col("o_orderkey")
    place = F.when(k % 5 == 0, _pick(list(REGION_STATES), k % 5)).otherwise(F.initcap(_pick(STATES, k % 27)))
    asked = F.concat_ws(
        " ",
        F.initcap(_pick(OPERATION_WORDS, k % len(OPERATION_WORDS))),
        F.lit("das emendas de"), _pick(TYPE_WORDS, k % len(TYPE_WORDS)), F.lit("para"), _pick(ASKED_AREAS, k % len(ASKED_AREAS)), F.lit("em"), place,
        F.when(k % 4 == 0, F.concat(F.lit("do "), F.col("partido"))),
        F.when(k % 3 == 0, F.concat(F.lit("de "), F.col("nome"))),
        F.when(k % 2 == 0, F.concat(F.lit("em "), k % 20 + 2000)).otherwise(F.concat(F.lit("entre 2021 e "), k % 20 + 2000)),
    )
    questions = rows.select(k.alias("id_consulta"), F.concat(asked, F.lit("?")).alias("consulta"))
    return _flat(q.extract_entities(questions, q.question_dictionary(t.legislators)).drop("consulta"))


@query(
    "d9_verify_entities",
    """WITH s AS (SELECT event_id AS id_consulta, CAST((event_id % 3 < 2) AS INTEGER) + CAST((event_id % 5 > 0) AS INTEGER) + CAST((event_id % 2 = 0) AS INTEGER) AS acertos FROM events)
       SELECT id_consulta, acertos, 3 AS total, round(acertos / 3, 4) AS precisao_entidades FROM s""",
)
def _(t):
    k = F.col("event_id")
    expected = F.create_map(F.lit("autor"), F.lit("roberto"), F.lit("ano"), F.lit("2024"), F.lit("area"), F.lit("saude"))
    author = F.when(k % 3 == 0, F.lit("Roberto Duarte")).when(k % 3 == 1, F.lit("ROBERTO")).otherwise(F.lit("Rob"))
    year = F.when(k % 5 > 0, F.lit("2024")).otherwise(F.lit("20245"))
    given = F.create_map(F.lit("autor"), author, F.lit("ano"), year)
    extracted = F.when(k % 2 == 0, F.map_concat(given, F.create_map(F.lit("area"), F.lit("Saude geral")))).otherwise(given)
    scored = q.verify_entities(t.table("events").select(k.alias("id_consulta"), extracted.alias("entidades"), expected.alias("esperado")))
    return scored.drop("entidades", "esperado")


# --- evaluation and presentation of answers ------------------------------------------------------


def _precision_sql(divisor: str, condition: str = "TRUE") -> str:
    return on_views(
        "vectors centroids amendments",
        f"""SELECT id_consulta, relevantes, round(relevantes / {divisor}, 4) AS precisao FROM (
            SELECT c.id_consulta, CAST(coalesce(sum(CASE WHEN contains(funcao_nome, CASE WHEN c.id_consulta % 2 = 0 THEN 'URG' ELSE 'MED' END)
              OR contains(funcao_nome, 'LOW') THEN 1 ELSE 0 END), 0) AS BIGINT) AS relevantes, count(r.id) AS n
            FROM centroids c LEFT JOIN (SELECT * FROM ranked WHERE posicao <= 5) r ON r.id_consulta = c.id_consulta LEFT JOIN amendments a ON a.id = r.id GROUP BY 1)""",
        pairs=f"SELECT * FROM ({PAIRS}) WHERE {condition}", ranked=CUT,
    )


def _precision(t: Tables, threshold: float | None, of_returned: bool) -> DataFrame:
    asked = writers.written(_asked(t), "perguntas")
    parts = F.array(F.when(F.col("id_consulta") % 2 == 0, F.lit("URG")).otherwise(F.lit("MED")), F.lit("LOW"))
    found = v.semantic_topk(asked, _corpus(t), k=5, threshold=threshold)
    return aggregates.precision_at_k(asked.select("id_consulta", parts.alias("fragmentos")), found, t.amendments(author=False), 5, of_returned)


@query("a8_precision_at_k", _precision_sql("5"))
def _(t):
    return _precision(t, None, False)


@query("a8_precision_of_returned", _precision_sql("greatest(least(n, 5), 1)", "s >= 0.4"))
def _(t):
    return _precision(t, 0.4, True)


def _few_answers(t: Tables) -> DataFrame:
    return writers.written(q.answer_many(_label_filters(t), t.amendments(paid=True), t.legislators), "respostas")


LINE_SQL = """posicao || '. Autor: ' || nome_autor || ' | Partido: ' || partido_autor || ' | UF: ' || uf || ' | Ano: ' || ano || ' | Função: ' || funcao_nome
    || ' | Subfunção: ' || subfuncao_nome || ' | Empenhado: R$ ' || format('{:,.2f}', valor_empenhado::DOUBLE) || ' | Pago: R$ ' || format('{:,.2f}', valor_pago::DOUBLE)"""


@query(
    "p4_context_lines",
    on_views("vectors amendments", f"SELECT id_consulta, string_agg({LINE_SQL}, chr(10) ORDER BY posicao) AS contexto FROM s JOIN amendments USING (id) GROUP BY 1", s=FILL_STRUCTURED),
)
def _(t):
    return present.context_lines(_few_answers(t))


@query(
    "p5_sources",
    on_views("vectors amendments", """SELECT id_consulta, 'https://portaldatransparencia.gov.br' || CASE WHEN bool_or(cod_autor % 50 = 0) THEN ',https://dadosabertos.camara.leg.br' ELSE '' END AS fontes
        FROM s JOIN amendments USING (id) GROUP BY 1""", s=FILL_STRUCTURED),
)
def _(t):
    rows = _few_answers(t).withColumn("partido", F.when(F.col("cod_autor") % 50 == 0, F.col("partido")))
    return present.sources(rows).withColumn("fontes", F.array_join("fontes", ","))
