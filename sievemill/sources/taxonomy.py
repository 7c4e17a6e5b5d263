"""Taxonomies as long tables: domain, dimension, value, ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GENERIC_TAXONOMY

SCHEMA = "domain string, dimension string, value string, ordinal int"


class TaxonomyError(ValueError):
    """A taxonomy breaks a rule; the message names the first violation."""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("_path", F.input_file_name())
    return raw.select(F.regexp_extract(F.url_decode("_path"), r"([^/]+)\.json$", 1).alias("domain"), F.col("value").alias("doc"))


def violations(files: DataFrame) -> DataFrame:
    """domain, dimension, problem for every rule that a taxonomy file (domain, doc) breaks."""
    v = files.withColumn("v", F.try_parse_json("doc"))
    kind = F.schema_of_variant("v")
    top = v.where(F.col("v").isNull() | ~kind.startswith("OBJECT")).select("domain", F.lit(None).cast("string").alias("dimension"), F.lit("not a JSON object").alias("problem"))
    empty = v.where(kind.startswith("OBJECT") & (F.size(F.json_object_keys("doc")) == 0)).select("domain", F.lit(None).cast("string"), F.lit("no dimensions"))
    dims = v.where(kind.startswith("OBJECT")).select("domain", F.explode(F.from_json("doc", "map<string,string>")).alias("dimension", "raw"))
    items = dims.withColumn("items", F.from_json("raw", "array<string>")).withColumn("is_list", F.trim("raw").startswith("["))
    named = items.where(F.trim("dimension") == "").select("domain", "dimension", F.lit("empty dimension name"))
    lists = items.where(~F.col("is_list") | (F.size("items") <= 0)).select("domain", "dimension", F.lit("not a list of values"))
    kinds = F.transform(F.from_json("raw", "array<string>"), lambda x: x)
    typed = items.where("is_list").withColumn("bad", F.exists(F.split(F.regexp_replace(F.col("raw"), r'"(?:[^"\\]|\\.)*"', "s"), r"[\[\],]"), lambda x: ~F.trim(x).isin("", "s")))
    typed = typed.where("bad").select("domain", "dimension", F.lit("value that isn't a string"))
    blank = items.where("is_list").where(F.exists(kinds, lambda x: F.trim(x) == "")).select("domain", "dimension", F.lit("empty value"))
    twice = items.where("is_list").select("domain", "dimension", F.explode("items").alias("value")).groupBy("domain", "dimension", "value").count().where("count > 1")
    twice = twice.select("domain", "dimension", F.concat(F.lit("duplicate value "), "value"))
    out = top
    for part in (empty, named, lists, typed, blank, twice):
        out = out.unionByName(part.toDF("domain", "dimension", "problem"))
    return out


def load_taxonomy(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    """The taxonomy of one domain, checked. A missing file or a broken rule raises ``TaxonomyError``."""
    files = _files(spark, folder).where(F.col("domain") == domain)
    if not files.limit(1).count():
        raise TaxonomyError(f"no taxonomy for domain {domain!r}")
    if bad := violations(files).orderBy("dimension", "problem").first():
        raise TaxonomyError(f"{bad['domain']}: {bad['dimension'] or ''}: {bad['problem']}")
    dims = files.select("domain", F.explode(F.from_json("doc", "map<string,array<string>>")).alias("dimension", "items"))
    return dims.select("domain", "dimension", F.posexplode("items").alias("ordinal", "value")).select("domain", "dimension", "value", "ordinal")


def list_domains(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("domain").distinct().orderBy("domain")


def from_columns(df: DataFrame, domain: str, columns: list[str]) -> DataFrame:
    """A taxonomy of the distinct values of ``columns``, in code point order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    seen = df.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()
    ordinal = F.row_number().over(W.partitionBy("dimension").orderBy("value")) - 1
    return seen.select(F.lit(domain).alias("domain"), "dimension", "value", ordinal.alias("ordinal"))


def generic_taxonomy(spark: SparkSession, domain: str) -> DataFrame:
    """The built-in taxonomy that goes with a free-text brief."""
    rows = [(domain, d, v, i) for d, values in GENERIC_TAXONOMY.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def slug(label: Column | str, length: int = 48) -> Column:
    """A domain label as an identifier: lower case, runs of other signs as one underscore, `custom` if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(F.col(label) if isinstance(label, str) else label)), r"[^\p{L}\p{N}]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, length)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("custom"))
