"""Writers: tables, incremental snapshots, reports, and shared scratch tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: str | None = "ano", mode: str = "errorifexists") -> None:
    """One atomic Parquet write, laid out by ``partition_by``.

    Rows go to their partition's tasks first, with AQE splitting the large
    partitions, so that a year is neither one huge file nor thousands of tiny ones.
    """
    rows = df.hint("rebalance", partition_by) if partition_by else df
    writer = rows.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: str = "ano") -> None:
    """Overwrite only the partitions present in ``df``; the others stay.

    ``df`` must not read from ``path`` itself; write a scratch table first.
    """
    rows = df.hint("rebalance", partition_by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows as JSON lines; metrics are small, so one file."""
    metrics.repartition(1).write.mode(mode).json(path)


def append_log(records: DataFrame, path: str) -> None:
    """Append question-log records."""
    records.write.mode("append").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="erario-"))
        shared = context.getCheckpointDir()
    return f"{shared.rstrip('/')}/erario-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that is used more than once and continue from the stored table.

    It cuts the lineage and survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored tables of more rows than this are not broadcast.
BROADCAST_ROWS = 100_000


def join_side(stored: DataFrame) -> DataFrame:
    """A stored table as one side of a join: Spark may broadcast it only when it has few rows.

    Files of repeated values say little about the memory their rows take, and a broadcast
    passes through the driver.
    """
    return stored if stored.count() <= BROADCAST_ROWS else stored.hint("merge")
