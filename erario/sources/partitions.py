"""Loads that rewrite only the partitions they touch, in two steps that a rerun completes or discards.

A load first stores the whole new contents of the touched partitions beside the table, under
``<path>.staged``, and names these partitions in a manifest that appears by one rename.  Only
then are the partitions replaced.  A run that dies before the manifest leaves the table as it
was; one that dies later is completed from the staged rows, as often as it takes.  One load at
a time may run on a table.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from erario.operators.integrity import touched_partitions, upsert
from erario.sources.writers import replace_partitions


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def _among(column: str, values: list) -> Column:
    """A filter that Spark answers from the folder names; null is a partition too."""
    given = F.col(column).isin([v for v in values if v is not None])
    return given | F.col(column).isNull() if None in values else F.coalesce(given, F.lit(False))


def read_partitioned(spark: SparkSession, path: str, partition: StructField) -> DataFrame:
    """A table whose partitions may lack columns that later loads brought; the partition column has the type given."""
    found = spark.read.option("mergeSchema", True).parquet(path).schema
    schema = StructType([partition if f.name == partition.name else f for f in found])
    return spark.read.schema(schema).parquet(path)


def stage(batch: DataFrame, path: str, key: str, partition_by: str = "ano", keep: tuple[str, ...] = ("embedding",)) -> bool:
    """Store the new contents of the partitions that an upsert of ``batch`` touches; False if there are none.

    ``batch`` holds one row per key.  The other partitions are read for their keys alone.
    The touched values come to the driver: one for each folder that the load writes or empties,
    fewer than the driver lists to plan a scan of the table.
    """
    spark, rows, manifest = batch.sparkSession, f"{path}.staged/rows", f"{path}.staged/manifest"
    partition = batch.schema[partition_by]
    if _exists(spark, path):
        stored = read_partitioned(spark, path, partition)
        touched = [r[0] for r in touched_partitions(stored, batch, key, partition_by).collect()]
        new = upsert(stored.filter(_among(partition_by, touched)), batch, key, keep)
    else:
        touched, new = [r[0] for r in batch.select(partition_by).distinct().collect()], batch
    if not touched:
        return False
    new.write.mode("overwrite").parquet(rows)
    filled = spark.read.schema(new.schema).parquet(rows).select(F.col(partition_by).alias("value")).distinct().withColumn("filled", F.lit(True))
    listed = spark.createDataFrame([(v,) for v in touched], StructType([StructField("value", partition.dataType)]))
    emptied = listed.join(filled, listed["value"].eqNullSafe(filled["value"]), "left_anti")
    emptied.write.mode("overwrite").parquet(f"{manifest}.part")
    files, part = _files(spark, f"{manifest}.part")
    if not files.rename(part, _files(spark, manifest)[1]):
        raise RuntimeError(f"cannot write {manifest}")
    return True


def complete(spark: SparkSession, path: str, partition_by: str = "ano") -> bool:
    """Bring a staged load into the table, or discard one that was not staged to its end; True if rows came in.

    Folders that the load empties are removed: overwriting alone would leave re-dated rows in them.
    """
    staged = f"{path}.staged"
    whole = _exists(spark, f"{staged}/manifest")
    if whole:
        replace_partitions(spark.read.parquet(f"{staged}/rows"), path, partition_by)
        name_of = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for row in spark.read.parquet(f"{staged}/manifest").collect():
            _delete(spark, f"{path}/{name_of(partition_by, None if row.value is None else str(row.value))}")
    if _exists(spark, staged):
        _delete(spark, staged)
    return whole
