"""Sinks and sources of a run: JSON lines, example and vector tables, and the manifest of checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import exists

RECORD = (
    "id string, instruction string, response string, reasoning_trace string, metadata struct<taxonomy_node:map<string,string>,"
    "generator_model:string,critic_scores:map<string,int>,composite_score:double,nearest_neighbor_similarity:double,"
    "generation_pass:int,difficulty_level:string,timestamp:string>"
)
MANIFEST = (
    "run_id string, domain string, target bigint, accepted_count bigint, rejected_count bigint, last_node_idx bigint, "
    "vendi_score double, taxonomy_coverage map<string,bigint>, timestamp timestamp, extra map<string,string>"
)


def write_text(rows: DataFrame, path: str) -> None:
    """One row's text (column ``value``) as one file at ``path``, through the file system that the path names."""
    where = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(rows.first()["value"].encode()))
    out.close()


def output_records(examples: DataFrame) -> DataFrame:
    """The nested output record of accepted examples (example_id, prompt, completion, taxonomy_node, rubric, ...)."""
    of = lambda c, kind: F.col(c) if c in examples.columns else F.lit(None).cast(kind)
    return examples.select(
        F.col("example_id").alias("id"),
        F.col("prompt").alias("instruction"),
        F.col("completion").alias("response"),
        of("reasoning_trace", "string").alias("reasoning_trace"),
        F.struct(
            F.col("taxonomy_node").alias("taxonomy_node"),
            of("generator_model", "string").alias("generator_model"),
            F.col("rubric").alias("critic_scores"),
            F.col("composite_score").alias("composite_score"),
            of("nearest_neighbor_similarity", "double").alias("nearest_neighbor_similarity"),
            F.lit(1).alias("generation_pass"),
            of("difficulty_level", "string").alias("difficulty_level"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        ).alias("metadata"),
    )


# What is read of tables written step by step: a step without rows has no file to tell the columns.
STEP_EXAMPLES = "example_id string, node_id string, taxonomy_node map<string,string>, step string, domain string"
STEP_VECTORS = "id string, vector array<float>, composite_score double, step string, domain string"


def _step(path: str, step: str | None) -> tuple[str, str]:
    """Where and how a sink writes: a step has a folder of its own, which a repetition of the step replaces."""
    return (path, "append") if step is None else (f"{path}/step={step}", "overwrite")


def of_steps(rows: DataFrame, steps: DataFrame | None) -> DataFrame:
    """Rows of the given ``steps`` (step) of a table written step by step, without that column; other steps' folders aren't read."""
    if steps is None:
        return rows
    return rows.join(steps.select("step").distinct(), "step", "left_semi").drop("step")


def committed_steps(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """The steps that the manifest at ``path`` vouches for: what a step wrote counts once its manifest rows are there."""
    rows = read_manifest(spark, path)
    rows = rows if domain is None else rows.where(F.col("domain") == domain)
    return rows.select(F.col("extra")["step"].alias("step")).where("step is not null").distinct()


def step_examples(spark: SparkSession, path: str, domain: str, steps: DataFrame) -> DataFrame:
    """example_id, node_id, taxonomy_node of a domain's examples in the given steps."""
    return of_steps(spark.read.schema(STEP_EXAMPLES).parquet(path), steps).where(F.col("domain") == domain).drop("domain")


def write_jsonl(examples: DataFrame, path: str, step: str | None = None) -> None:
    """Append output records as JSON lines, or replace those of a ``step``; nulls are written, text isn't escaped beyond JSON."""
    place, mode = _step(path, step)
    output_records(examples).write.mode(mode).option("ignoreNullFields", "false").json(place)


def read_jsonl(spark: SparkSession, path: str, preview: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    rows = spark.read.schema(RECORD + (", step string" if steps is not None else "")).json(path)
    rows = of_steps(rows, steps)
    return rows.limit(preview) if preview is not None else rows


def example_rows(examples: DataFrame) -> DataFrame:
    """The example table's columns: domain from the taxonomy node (else empty), maps as maps, a write time."""
    kept = [c for c in ("example_id", "node_id", "prompt", "completion", "generator_model", "prefilter_score", "composite_score", "rubric", "verdict", "taxonomy_node", "created_at") if c in examples.columns]
    return examples.select(*kept, F.current_timestamp().alias("stored_at"), F.coalesce(F.col("taxonomy_node")["domain"], F.lit("")).alias("domain"))


def write_examples(examples: DataFrame, path: str, step: str | None = None) -> None:
    """Append examples whose id isn't stored yet, partitioned by domain; or replace those of a ``step``."""
    spark = examples.sparkSession
    rows = example_rows(examples.dropDuplicates(["example_id"]))
    if step is None and exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("example_id"), "example_id", "left_anti")
    place, mode = _step(path, step)
    rows.write.mode(mode).partitionBy("domain").parquet(place)


def checked_vectors(vectors: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """``vectors`` as array<float>; a vector of another dimension fails the job."""
    right = F.coalesce(F.size(column) == dim, F.lit(False))
    checked = F.when(right, F.col(column).cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension is not {dim}: "), F.coalesce(F.size(column).cast("string"), F.lit("null")))).cast("array<float>"))
    return vectors.withColumn(column, checked)


def write_vectors(vectors: DataFrame, path: str, dim: int, step: str | None = None) -> None:
    """Append id, domain, vector, composite_score, partitioned by domain; or replace those of a ``step``."""
    place, mode = _step(path, step)
    checked_vectors(vectors.select("id", "vector", "composite_score", F.coalesce("domain", F.lit("")).alias("domain")), dim).write.mode(mode).partitionBy("domain").parquet(place)


def stored_vectors(spark: SparkSession, path: str, domain: str | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Stored vectors, of one domain and of given steps if told so: partition filters, so that others aren't read."""
    rows = spark.read.parquet(path) if steps is None else of_steps(spark.read.schema(STEP_VECTORS).parquet(path), steps)
    return rows if domain is None else rows.where(F.col("domain") == domain)


def run_id(domain: Column | str, at: Column | None = None) -> Column:
    """run_<time>_<domain>, with signs other than letters, digits, _ and - as underscores."""
    at = F.current_timestamp() if at is None else at
    return F.concat(F.lit("run_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.regexp_replace(F.col(domain) if isinstance(domain, str) else domain, "[^A-Za-z0-9_-]", "_"))


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append checkpoint rows. An unsafe run id fails; earlier rows are never overwritten."""
    spark = rows.sparkSession
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], MANIFEST).schema])
    safe = F.when(F.col("run_id").rlike("^[A-Za-z0-9_-]+$"), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("unsafe run id: "), F.coalesce("run_id", F.lit("null")))).cast("string"))
    full.withColumn("run_id", safe).write.mode("append").option("ignoreNullFields", "false").json(path)


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """The newest checkpoint of each domain. Domains are compared whole."""
    return manifest.groupBy("domain").agg(F.max_by(F.struct(*[c for c in manifest.columns if c != "domain"]), F.struct("timestamp", "accepted_count", "run_id")).alias("r")).select("domain", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All checkpoint rows that parse; corrupt lines are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST + ", _corrupt_record string").json(path)
    return rows.where("_corrupt_record is null and run_id is not null").drop("_corrupt_record")


def status(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """One row: the domain's newest checkpoint, or status `no_checkpoint`."""
    one = spark.createDataFrame([(domain,)], "domain string")
    rows = one.join(latest_manifest(read_manifest(spark, path)), "domain", "left")
    return rows.withColumn("status", F.when(F.col("run_id").isNull(), "no_checkpoint").otherwise("ok"))

