"""Readers of landed files. All schemas are explicit; nothing is inferred.

Pages are landed as text with one JSON document (a record, an array of records
or a ``{"dados": ...}`` page) per line, so that Spark can split the files.  A
document spread over many lines needs ``multi_line`` and is read by one task.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from erario import schemas
from erario.functions.fixed_values import DEFAULT_LEGISLATURE


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array; one row per element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_amendments(
    spark: SparkSession, path: str, years: list[int] | None = None, multi_line: bool = False
) -> DataFrame:
    """Landed amendment pages under ``path/ano=YYYY/``, optionally of some years only.

    The year of the folder counts, and only the folders of the given years are read.
    """
    raw = spark.read.schema(schemas.RAW_AMENDMENTS).option("multiLine", multi_line).json(path)
    return raw.filter(F.col("ano").isin(years)) if years else raw


def read_legislators(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed ``{"dados": [...]}`` pages under ``path/legislatura=N/``; one row per legislator."""
    page = f"dados array<struct<{_struct(schemas.RAW_LEGISLATORS)}>>, legislatura int"
    pages = spark.read.schema(page).option("multiLine", multi_line).json(path)
    rows = pages.select("legislatura", F.explode("dados").alias("d")).select("d.*", "legislatura")
    asked = F.coalesce("legislatura", "idLegislatura", F.lit(DEFAULT_LEGISLATURE))
    return rows.withColumn("idLegislatura", asked).drop("legislatura")


def _struct(schema: str) -> str:
    return ", ".join(": ".join(part.split()) for part in schema.split(","))


def read_legislator_details(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed ``{"dados": {...}}`` details; joins to the legislators on ``cod_autor``."""
    page = f"dados struct<{_struct(schemas.RAW_DETAILS)}>"
    details = spark.read.schema(page).option("multiLine", multi_line).json(path)

    def text(field: str) -> Column:
        return F.coalesce(F.col(f"dados.{field}"), F.lit(""))

    return details.select(
        F.col("dados.id").alias("cod_autor"),
        text("nomeCivil").alias("nome_civil"),
        F.col("dados.dataNascimento").alias("data_nascimento"),
        text("municipioNascimento").alias("municipio_nascimento"),
        text("escolaridade").alias("escolaridade"),
    )


def with_details(legislators: DataFrame, details: DataFrame) -> DataFrame:
    return legislators.join(details, "cod_autor", "left")


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated UTF-8 CSV with a header; every field is text."""
    return spark.read.csv(path, schema=schemas.RAW_CLASSIFICATION, sep=";", header=True, encoding="UTF-8")


def read_years(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Yearly inputs ``emendas_YYYY.json``, a file or a folder of files that each hold one JSON array.

    The year comes from the name, not from the record; absent years are skipped.  Without
    bounds all years are read.
    """
    raw = read_json_array(spark, f"{folder}/*emendas_[0-9][0-9][0-9][0-9].json", schemas.RAW_AMENDMENTS)
    year = F.regexp_extract(F.col("_metadata.file_path"), r"emendas_([0-9]{4})\.json", 1).cast("int")
    rows = raw.withColumn("ano", year)
    rows = rows if first is None else rows.filter(F.col("ano") >= first)
    return rows if last is None else rows.filter(F.col("ano") <= last)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors with their code and text side by side."""
    return spark.read.schema(schemas.VECTORS).parquet(path)
