"""Coverage of taxonomy values and its gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count(rows: DataFrame, domain: str | None = None) -> DataFrame:
    return (rows if domain is None else rows.where(F.col("domain") == domain)).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, domain: str | None = None, column: str = "dimensions") -> DataFrame:
    """dimension, value, n over all dimensions of a map column in one pass; null values are left out."""
    rows = rows if domain is None else rows.where(F.col("domain") == domain)
    return rows.select(F.explode(column).alias("dimension", "value")).where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def json_coverage(rows: DataFrame, column: str, key: str) -> DataFrame:
    """value, n of one key of a JSON text column; quotes around a value are dropped."""
    value = F.regexp_replace(F.get_json_object(column, f"$['{key}']"), '^"+|"+$', "")
    return rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def gaps(covered: DataFrame, expected: int | None, taxonomy: DataFrame | None = None) -> DataFrame:
    """dimension, value, deficit (most first) of values seen fewer than ``expected`` times.

    Values never seen count only with a ``taxonomy`` (dimension, value). ``expected`` null or below 1: no gaps.
    """
    if taxonomy is not None:
        covered = taxonomy.select("dimension", "value").join(covered, ["dimension", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    deficit = F.lit(expected if expected and expected > 0 else 0) - F.col("n")
    return covered.select("dimension", "value", deficit.cast("long").alias("deficit")).where("deficit > 0").orderBy(F.desc("deficit"), "dimension", "value")


def total_deficit(gaps_: DataFrame) -> DataFrame:
    return gaps_.agg(F.coalesce(F.sum("deficit"), F.lit(0)).cast("long").alias("deficit"))
