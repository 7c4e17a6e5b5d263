"""Request tables for batch inference: request_id, role, prompt, temperature, max_tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, RUBRIC_MAX, RUBRIC_MIN, RUBRIC_WEIGHTS


def json_text(c: Column | str) -> Column:
    """A string as a JSON string, with the standard escapes; null as an empty string."""
    whole = F.to_json(F.array(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def json_map(c: str) -> Column:
    """A map of strings as a JSON object with its keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(json_text(e["key"]), F.lit(": "), json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _request(rows: DataFrame, request_id: Column, role: str, prompt: Column, *more: str) -> DataFrame:
    temperature, tokens = DEFAULTS.roles[role]
    return rows.select(request_id.alias("request_id"), F.lit(role).alias("role"), prompt.alias("prompt"), F.lit(temperature).alias("temperature"), F.lit(tokens).alias("max_tokens"), *more)


def generation_requests(nodes: DataFrame, batch: int = DEFAULTS.generator_batch) -> DataFrame:
    """One request per node set (node_id, domain, dimensions, use_case)."""
    brief = F.when(F.length(F.trim("use_case")) > 0, F.concat(F.lit("Brief:\n"), F.trim("use_case"), F.lit("\n\n"))).otherwise("")
    prompt = F.concat(brief, F.lit(f"Write {batch} different training examples for the domain "), json_text("domain"), F.lit(".\nScenario: "), json_map("dimensions"), F.lit("\nAnswer with a JSON array of objects with the keys instruction and response."))
    return _request(nodes, F.col("node_id"), "generator", prompt, "node_id")


def screening_batches(examples: DataFrame, partition: str, order: list[str], batch: int = DEFAULTS.screening_batch) -> DataFrame:
    """``examples`` with batch (long) and pos (0 .. batch-1): runs of ``batch`` rows in ``order`` within a ``partition``."""
    n = F.row_number().over(W.partitionBy(partition).orderBy(*order)) - 1
    return examples.withColumn("_n", n).withColumn("batch", F.expr(f"_n div {batch}")).withColumn("pos", F.pmod("_n", F.lit(batch)).cast("int")).drop("_n")


def screening_id(partition: str) -> Column:
    """The request id of a batch of a ``partition``."""
    return F.concat_ws("-", F.lit("screen"), F.col(partition).cast("string"), F.col("batch").cast("string"))


def screening_requests(batched: DataFrame, partition: str) -> DataFrame:
    """One request per batch: a JSON line per example with its place in the batch, in order."""
    line = F.concat(F.lit('{"id": '), F.col("pos").cast("string"), F.lit(', "instruction": '), json_text("prompt"), F.lit(', "response": '), json_text("completion"), F.lit("}"))
    lines = batched.groupBy(partition, "batch").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    prompt = F.concat(F.lit("Decide for each line whether the example is usable.\n"), text, F.lit('\nAnswer with a JSON array of {"id": int, "pass": bool}.'))
    return _request(lines, screening_id(partition), "prefilter", prompt)


def scoring_requests(examples: DataFrame) -> DataFrame:
    """One request per example (example_id, prompt, completion)."""
    names = ", ".join(RUBRIC_WEIGHTS)
    schema = "{" + ", ".join(f'"{d}": int' for d in RUBRIC_WEIGHTS) + "}"
    head = f"Score each dimension from {RUBRIC_MIN} to {RUBRIC_MAX}: {names}.\nGive {RUBRIC_MIN} where the answer is false, unsafe or off topic.\nAnswer with JSON: {schema}\n\nInstruction:\n"
    return _request(examples, F.col("example_id"), "scorer", F.concat(F.lit(head), F.coalesce("prompt", F.lit("")), F.lit("\n\nResponse:\n"), F.coalesce("completion", F.lit(""))), "example_id")
