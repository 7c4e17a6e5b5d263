"""The stored band index: the MinHash buckets of everything that was kept, by which later batches and runs find their near-duplicates.

Rows are partitioned by a slot of the bucket's hash below each step's folder. A lookup is an equi-join on slot and bucket, so a small batch reads the slots of
its own buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import shingles
from .storage import exists
from .tables import of_steps

SLOTS = 64
SCHEMA = "id string, bucket string, run_id string, step string, slot int"


def slot(bucket: Column | str) -> Column:
    return F.pmod(F.crc32(bucket), F.lit(SLOTS)).cast("int")


def text_buckets(rows: DataFrame, key: str, text: str, settings: Settings = DEFAULTS) -> DataFrame:
    """key, bucket of each band of a text's MinHash signature; null texts are empty, and empty ones have none. Texts are signed where they lie: none is shuffled."""
    signed = rows.select(key, shingles.text_signature(text, settings.ngram, settings.permutations).alias("minhash"))
    return signed.where("minhash is not null").select(key, F.explode(shingles.band_keys("minhash", settings.bands, settings.band_rows)).alias("bucket"))


def write_bands(buckets: DataFrame, path: str, step: str, run_id: str = "") -> None:
    """Write the buckets (id, bucket) of a step's kept rows; a repetition of the step replaces them."""
    rows = buckets.select(F.col("id").cast("string").alias("id"), "bucket", F.lit(run_id).alias("run_id"), slot("bucket").alias("slot"))
    rows.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/step={step}")


def read_bands(spark: SparkSession, path: str, steps: DataFrame | None = None, run_id: str | None = None) -> DataFrame:
    """id, bucket, slot of the given steps (step), all if None, and of one run if told so."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA).select("id", "bucket", "slot")
    rows = of_steps(spark.read.schema(SCHEMA).parquet(path), steps)
    rows = rows if run_id is None else rows.where(F.col("run_id") == run_id)
    return rows.select("id", "bucket", "slot")


def colliding(buckets: DataFrame, stored: DataFrame, key: str = "ord") -> DataFrame:
    """The keys of ``buckets`` (key, bucket) that share one with ``stored`` (slot, bucket)."""
    return buckets.withColumn("slot", slot("bucket")).join(stored.select("slot", "bucket"), ["slot", "bucket"], "left_semi").select(key).distinct()
