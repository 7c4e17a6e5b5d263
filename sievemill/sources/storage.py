"""Paths and scratch tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose write has ended, in order."""
    if not exists(spark, path):
        return []
    system, where = _place(spark, path)
    names = sorted(x.getPath().getName() for x in system.listStatus(where) if x.isDirectory())
    return [n for n in names if exists(spark, f"{path}/{n}/_SUCCESS")]


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, where = _place(spark, path)
        system.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a local one only where none is named, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a table in the folder that all executors share."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._written_path = path
    return again


def delete(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written_path", None):
            remove(t.sparkSession, path)


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Adds ``name``, from 1 in ``order``: places within ranges of the order plus the sizes of the ranges before, so that no task sees all rows."""
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    sizes = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each range
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(sizes), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_before")
