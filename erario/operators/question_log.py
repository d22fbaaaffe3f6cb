"""The question log: rows to append, summaries, screening of stored SQL."""

from pyspark.sql import DataFrame, functions as F

from erario.functions.fixed_values import FORBIDDEN_SQL_WORDS
from erario.operators.aggregates import latency_stats


def log_rows(results: DataFrame) -> DataFrame:
    """Log records of answered questions; they always count as successful.

    Questions answered together have no latency of their own; it is logged when
    the caller measured one.
    """
    latency = F.col("latencia_ms") if "latencia_ms" in results.columns else F.lit(None)
    return results.select(
        F.col("consulta").alias("consulta_nl"),
        F.to_json("entidades").alias("entidades_json"),
        F.lit(None).cast("string").alias("sql_gerada"),
        F.col("modo").alias("modo_busca"),
        F.col("num_resultados").cast("int").alias("num_resultados"),
        latency.cast("int").alias("latencia_ms"),
        F.lit(True).alias("sucesso"),
        F.lit(None).cast("string").alias("erro"),
        F.current_timestamp().alias("created_at"),
    )


def log_summary(log: DataFrame, start=None, end=None) -> DataFrame:
    """Latency statistics per day and mode, optionally of a time range [start, end)."""
    if start is not None:
        log = log.filter(F.col("created_at") >= F.lit(start))
    if end is not None:
        log = log.filter(F.col("created_at") < F.lit(end))
    return latency_stats(log.withColumn("dia", F.to_date("created_at")), "dia", "modo_busca")


def screen_sql(log: DataFrame, column: str = "sql_gerada") -> DataFrame:
    """Flag stored SQL that contains a changing command; the first listed word found is named."""
    lowered = F.lower(column)
    word = F.coalesce(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in FORBIDDEN_SQL_WORDS])
    return log.withColumns({"comando_proibido": word, "sql_permitida": word.isNull()})
