"""Helpers that the operators of this subpackage share: tables, scratch tables, ids, components."""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
FREED_EVERY = 4  # tables that are stored
_tables = itertools.count(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the cluster names none, as in tests, a local one is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing.

    Every few tables the driver lets go of plans, broadcasts and shuffles that are done with: steps of many jobs would let its heap grow to its bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_path = path
    if not next(_tables) % FREED_EVERY:
        free_shuffles(spark)
    return again


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored_path", None):
            jvm = t.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and broadcasts of plans that nothing refers to any more, without waiting for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components by distributed union-find (alternating large-star and small-star rounds).

    ``edges`` has long columns ``u`` and ``v``; the result has ``node`` and ``component`` (its smallest node),
    one row for each node that has an edge to another node. Each round is two joins on the node with a unique
    right side, so a hub's rows can be split between tasks; nothing is collected but a count and a checksum.
    """

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = print_of(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nearest = low.select("u", F.col("m").alias("v"))
        new = stored(small.unionByName(nearest).where("u <> v").distinct(), "links")
        now = print_of(new)
        forget(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point; raise max_rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
