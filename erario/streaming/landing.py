"""Incremental landing: new amendment pages reach the stored table as they arrive."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from erario import schemas
from erario.operators.integrity import new_rows
from erario.plans.ingest import prepare_amendments
from erario.sources.writers import write_table


def read_landing(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of the landed pages under ``path/ano=YYYY/``, a bounded number of files per batch."""
    pages = spark.readStream.schema(schemas.RAW_AMENDMENTS).option("maxFilesPerTrigger", max_files).json(path)
    return pages.withColumn("_arquivo", F.col("_metadata.file_path"))


def _append_new(batch: DataFrame, legislators: DataFrame, table: str) -> None:
    spark = batch.sparkSession
    records = batch.withColumn("_registro", F.to_json(F.struct("*")))
    rows = prepare_amendments(records, legislators, ["ano", "_arquivo", "_registro"])
    stored = spark.read.schema(rows.schema).parquet(table) if _exists(spark, table) else rows.limit(0)
    write_table(new_rows(stored, rows, "codigo_emenda"), table, mode="append")


def _exists(spark: SparkSession, table: str) -> bool:
    try:
        return bool(spark.read.parquet(table).columns)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def land(spark: SparkSession, landing: str, legislators: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Start a run over everything that has arrived and not been stored yet; it ends by itself.

    Codes already stored are skipped, so a batch that is repeated after a
    failure adds no row.
    """
    return (
        read_landing(spark, landing)
        .writeStream.foreachBatch(lambda batch, _: _append_new(batch, legislators, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
