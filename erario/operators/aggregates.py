"""Counts, totals, top lists and evaluation metrics."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from erario.functions.money import format_usd_style

TOTAL = "decimal(38,2)"


def money_sum(column: str) -> Column:
    return F.sum(column).cast(TOTAL)


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def distinct_authors(df: DataFrame) -> DataFrame:
    return df.select("nome_autor").distinct().orderBy("nome_autor")


def per_year(df: DataFrame) -> DataFrame:
    """Count and committed sum per year, also as text."""
    totals = df.groupBy("ano").agg(F.count("*").alias("qtd"), money_sum("valor_empenhado").alias("empenhado"))
    return totals.withColumn("empenhado_texto", format_usd_style(F.col("empenhado"))).orderBy("ano")


def author_by_function(df: DataFrame) -> DataFrame:
    """Count, committed and paid sum per author and function."""
    totals = df.groupBy("nome_autor", "funcao_nome").agg(
        F.count("*").alias("qtd"),
        money_sum("valor_empenhado").alias("empenhado"),
        money_sum("valor_pago").alias("pago"),
    )
    return totals.withColumns(
        {"empenhado_texto": format_usd_style(F.col("empenhado")), "pago_texto": format_usd_style(F.col("pago"))}
    )


def top_authors(df: DataFrame, n: int = 5) -> DataFrame:
    """The n authors with the largest committed sum."""
    totals = df.groupBy("nome_autor").agg(F.count("*").alias("qtd"), money_sum("valor_empenhado").alias("empenhado"))
    top = totals.orderBy(F.desc("empenhado"), F.asc("nome_autor")).limit(n)
    return top.withColumn("empenhado_texto", format_usd_style(F.col("empenhado")))


def latency_stats(log: DataFrame, *by: str) -> DataFrame:
    """Mean, population deviation, extremes and count of the latency per group."""
    latency = F.col("latencia_ms")
    return log.groupBy(*by).agg(
        F.round(F.avg(latency), 2).alias("media_ms"),
        F.round(F.stddev_pop(latency), 2).alias("desvio_padrao_ms"),
        F.min(latency).alias("min_ms"),
        F.max(latency).alias("max_ms"),
        F.count(latency).alias("n_execucoes"),
    )


def precision_at_k(
    questions: DataFrame, ranked: DataFrame, corpus: DataFrame, k: int = 5, of_returned: bool = False
) -> DataFrame:
    """Share of relevant rows among the first k of every question.

    ``questions``: id_consulta, fragmentos (a row is relevant when its
    ``funcao_nome`` contains any of them); ``ranked``: id_consulta, id, posicao;
    ``corpus``: id, funcao_nome.  ``of_returned`` divides by the rows actually
    returned (at least 1) instead of by k.
    """
    first = ranked.filter(F.col("posicao") <= k).select("id_consulta", "id")
    named = corpus.select("id", "funcao_nome").join(first, "id")
    scored = questions.join(named, "id_consulta", "left").select(
        "id_consulta",
        F.col("id").isNotNull().cast("int").alias("_retornada"),
        F.coalesce(F.exists("fragmentos", lambda f: F.contains(F.col("funcao_nome"), f)), F.lit(False))
        .cast("int")
        .alias("_relevante"),
    )
    returned = F.sum("_retornada")
    divisor = F.greatest(F.least(returned, F.lit(k)), F.lit(1)) if of_returned else F.lit(k)
    return scored.groupBy("id_consulta").agg(
        F.sum("_relevante").alias("relevantes"),
        F.round(F.sum("_relevante") / divisor, 4).alias("precisao"),
    )


def class_report(results: DataFrame) -> DataFrame:
    """Per question class (first letter of the id): totals, successes and means over the successes."""
    ok = F.col("sucesso")

    def mean_of(column: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(ok, F.col(column))), F.lit(0.0)), 4)

    return results.groupBy(F.substring("id", 1, 1).alias("tipo")).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("sucessos"),
        mean_of("precisao_entidades").alias("precisao"),
        mean_of("latencia_ms").alias("latencia_media_ms"),
    )


def _amount(measure: str) -> Column:
    return money_sum(measure)


def total(df: DataFrame, measure: str = "valor_empenhado") -> DataFrame:
    return df.agg(_amount(measure).alias("valor"), F.count("*").alias("qtd"))


def ranking(df: DataFrame, by: str, measure: str = "valor_empenhado", n: int = 20) -> DataFrame:
    """The n largest groups by summed measure."""
    totals = df.groupBy(by).agg(_amount(measure).alias("valor"), F.count("*").alias("qtd"))
    return totals.orderBy(F.desc("valor"), F.asc(by)).limit(n)


def ranking_within(df: DataFrame, group: str, by: str, measure: str = "valor_empenhado", n: int = 3) -> DataFrame:
    """The n largest members of every group; equal sums share a rank."""
    totals = df.groupBy(group, by).agg(_amount(measure).alias("valor"), F.count("*").alias("qtd"))
    position = F.rank().over(Window.partitionBy(group).orderBy(F.desc("valor")))
    return totals.withColumn("posicao", position).filter(F.col("posicao") <= n)


def mean(df: DataFrame, measure: str = "valor_empenhado") -> DataFrame:
    """Decimal sum over count, rounded to cents; empty input gives null."""
    return df.agg(
        F.round(_amount(measure) / F.nullif(F.count(measure), F.lit(0)), 2).alias("media"), F.count(measure).alias("qtd")
    )


def count_distinct(df: DataFrame, column: str = "nome_autor", approximate: bool = False) -> DataFrame:
    """Distinct values; ``approximate`` trades exactness for one light pass without a value shuffle."""
    counted = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.agg(counted.alias("distintos"))


def compare(df: DataFrame, dimension: str, values: list[str], measure: str = "valor_empenhado") -> DataFrame:
    """One row per year, one summed column per compared value."""
    sums = [
        F.coalesce(_amount_if(measure, F.col(dimension) == value), F.lit(0).cast(TOTAL)).alias(value) for value in values
    ]
    return df.filter(F.col(dimension).isin(list(values))).groupBy("ano").agg(*sums).orderBy("ano")


def _amount_if(measure: str, condition: Column) -> Column:
    return F.sum(F.when(condition, F.col(measure))).cast(TOTAL)


def trend(df: DataFrame, *group: str, measure: str = "valor_empenhado") -> DataFrame:
    """Yearly sum with its change against the previous and the first year.

    The windows run over the yearly sums, a handful of rows per group.
    """
    yearly = df.groupBy(*group, "ano").agg(_amount(measure).alias("valor"))
    years = Window.partitionBy(*group).orderBy("ano")
    previous, first = F.lag("valor").over(years), F.first("valor").over(years)
    return yearly.withColumns(
        {
            "variacao_anterior": (F.col("valor") - previous).cast(TOTAL),
            "variacao_inicial": (F.col("valor") - first).cast(TOTAL),
        }
    )


def growth_ranking(df: DataFrame, dimension: str, first_year: int, last_year: int, measure: str = "valor_empenhado") -> DataFrame:
    """Groups ordered by their growth between two years."""
    zero = F.lit(0).cast(TOTAL)
    sums = (
        df.filter(F.col("ano").isin(first_year, last_year))
        .groupBy(dimension)
        .agg(
            F.coalesce(_amount_if(measure, F.col("ano") == first_year), zero).alias("valor_inicial"),
            F.coalesce(_amount_if(measure, F.col("ano") == last_year), zero).alias("valor_final"),
        )
    )
    growth = (F.col("valor_final") - F.col("valor_inicial")).cast(TOTAL)
    return sums.withColumn("crescimento", growth).orderBy(F.desc("crescimento"), F.asc(dimension))


def ratio(df: DataFrame, *by: str) -> DataFrame:
    """Paid over committed; null when nothing was committed."""
    totals = df.groupBy(*by).agg(_amount("valor_empenhado").alias("empenhado"), _amount("valor_pago").alias("pago"))
    share = F.col("pago").cast("double") / F.nullif(F.col("empenhado").cast("double"), F.lit(0.0))
    return totals.withColumn("proporcao", F.round(share, 6))


def list_distinct(df: DataFrame, column: str = "nome_autor") -> DataFrame:
    return df.select(column).distinct().orderBy(column)
