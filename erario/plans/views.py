"""Amendment-like views over the star-schema test tables, in Spark and in SQL.

Orders stand for amendments, customers for legislators, line items for
execution movements, parts for the budget classification, events for the
question log.  Columns that need a join are optional, so that a query pays
only for what it reads.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

from erario.functions.money import AMOUNT

TYPES = {"F": "Individual", "O": "Bancada", "P": "Comissão"}
PHASES = {"A": "empenho", "N": "liquidacao", "R": "pagamento"}


def _mapped(column: str, pairs: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in pairs.items()])


def plain_money(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the form results are compared in."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


class Tables:
    """The test tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def legislators(self) -> DataFrame:
        nations = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("uf"))
        return (
            self.table("customer")
            .join(nations, "c_nationkey")
            .select(
                F.col("c_custkey").alias("cod_autor"), F.upper("c_name").alias("nome"), F.col("c_mktsegment").alias("partido"), "uf"
            )
        )

    @cached_property
    def regions(self) -> DataFrame:
        joined = self.table("region").join(self.table("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
        return joined.groupBy(F.lower("r_name").alias("nome")).agg(F.sort_array(F.collect_list("n_name")).alias("ufs"))

    def amendments(self, author: bool = True, paid: bool = False) -> DataFrame:
        """``author`` adds nome_autor, uf and localidade; ``paid`` adds valor_pago."""
        priority, quarter = F.col("o_orderpriority"), F.quarter("o_orderdate").cast("string")
        function = F.concat(F.lit("0"), F.substring(priority, 1, 1))
        name = F.substring(priority, 3, 100)
        rows = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").cast("string").alias("codigo_emenda"),
            F.col("o_custkey").alias("cod_autor"),
            F.year("o_orderdate").alias("ano"),
            _mapped("o_orderstatus", TYPES).alias("tipo_emenda"),
            function.alias("funcao"),
            name.alias("funcao_nome"),
            F.concat(function, quarter).alias("subfuncao"),
            F.concat(name, F.lit(" T"), quarter).alias("subfuncao_nome"),
            F.col("o_totalprice").cast(AMOUNT).alias("valor_empenhado"),
            F.lit(0).cast(AMOUNT).alias("valor_liquidado"),
        )
        if author:
            people = self.legislators.select("cod_autor", F.col("nome").alias("nome_autor"), "uf")
            rows = rows.join(people, "cod_autor").withColumn("localidade", F.concat("uf", F.lit(" (UF)")))
        if paid:
            totals = (
                self.table("lineitem")
                .filter("l_returnflag = 'R'")
                .groupBy(F.col("l_orderkey").alias("id"))
                .agg(F.sum(F.col("l_extendedprice").cast(AMOUNT)).alias("_pago"))
            )
            pago = F.coalesce(F.col("_pago"), F.lit(0)).cast(AMOUNT)
            rows = rows.join(totals, "id", "left").withColumn("valor_pago", pago).drop("_pago")
        return rows

    @cached_property
    def movements(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("emenda_id"),
            F.to_date("l_shipdate").alias("data_movimento"),
            F.col("l_extendedprice").cast(AMOUNT).alias("valor"),
            _mapped("l_returnflag", PHASES).alias("fase"),
        )

    @cached_property
    def classification(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.upper(F.substring("p_type", 1, 2)).alias("funcao"),
            F.col("p_type").alias("funcao_nome"),
            F.regexp_extract("p_brand", "([0-9]+)", 1).alias("subfuncao"),
            F.col("p_brand").alias("subfuncao_nome"),
            F.col("p_size").cast("string").alias("programa"),
            F.col("p_name").alias("programa_nome"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @cached_property
    def question_log(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("modo_busca"),
            F.round("value").cast("int").alias("latencia_ms"),
            (F.col("event_type") != "error").alias("sucesso"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )


# The same views in SQL, as common table expressions.
SQL_VIEWS = {
    "legislators": """SELECT c_custkey AS cod_autor, upper(c_name) AS nome, c_mktsegment AS partido, n_name AS uf
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "regions": """SELECT lower(r_name) AS nome, list(n_name ORDER BY n_name) AS ufs
        FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""",
    "paid": """SELECT l_orderkey AS id, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS pago
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
    "amendments": """SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS codigo_emenda, o_custkey AS cod_autor,
            nome AS nome_autor, CAST(year(o_orderdate) AS INTEGER) AS ano,
            CASE o_orderstatus WHEN 'F' THEN 'Individual' WHEN 'O' THEN 'Bancada' ELSE 'Comissão' END AS tipo_emenda,
            '0' || substr(o_orderpriority, 1, 1) AS funcao, substr(o_orderpriority, 3) AS funcao_nome,
            '0' || substr(o_orderpriority, 1, 1) || quarter(o_orderdate) AS subfuncao,
            substr(o_orderpriority, 3) || ' T' || quarter(o_orderdate) AS subfuncao_nome,
            uf, uf || ' (UF)' AS localidade, partido AS partido_autor,
            CAST(o_totalprice AS DECIMAL(15,2)) AS valor_empenhado, CAST(0 AS DECIMAL(15,2)) AS valor_liquidado,
            CAST(coalesce(pago, 0) AS DECIMAL(15,2)) AS valor_pago
        FROM orders JOIN legislators ON o_custkey = cod_autor LEFT JOIN paid ON paid.id = o_orderkey""",
    "movements": """SELECT l_orderkey AS emenda_id, CAST(l_shipdate AS DATE) AS data_movimento,
            CAST(l_extendedprice AS DECIMAL(15,2)) AS valor,
            CASE l_returnflag WHEN 'A' THEN 'empenho' WHEN 'N' THEN 'liquidacao' ELSE 'pagamento' END AS fase
        FROM lineitem""",
    "classification": """SELECT p_partkey AS id, upper(substr(p_type, 1, 2)) AS funcao, p_type AS funcao_nome,
            regexp_extract(p_brand, '([0-9]+)', 1) AS subfuncao, p_brand AS subfuncao_nome,
            CAST(p_size AS VARCHAR) AS programa, p_name AS programa_nome FROM part""",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label FROM embeddings",
    "question_log": """SELECT event_id AS id, event_type AS modo_busca, CAST(round(value) AS INTEGER) AS latencia_ms,
            event_type <> 'error' AS sucesso, ts AS created_at FROM events""",
    "centroids": """SELECT label AS id_consulta, list(media ORDER BY lugar) AS embedding FROM (
            SELECT label, lugar, avg(v) AS media FROM (
                SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS lugar FROM vectors)
            GROUP BY label, lugar) GROUP BY label""",
}
NEEDS = {"amendments": ["legislators", "paid"], "centroids": ["vectors"]}


def on_views(views: str, body: str, **more: str) -> str:
    """SQL text with the named views (and ``more`` named queries after them) in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for view in views.split():
        add(view)
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in wanted] + [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}"
