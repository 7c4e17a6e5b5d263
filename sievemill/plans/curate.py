"""The end-to-end run: replies in, curated examples out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import embed, replies, shingles
from ..operators import dedup, scoring
from ..sources.storage import delete, numbered, written


def hydrate(examples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds taxonomy_node: domain and node_id with the node's dimensions, which win on a clash; a missing node leaves the two."""
    n = nodes.select("node_id", F.col("domain").alias("_domain"), "dimensions")
    rows = examples.join(n, "node_id", "left")
    base = F.map_from_arrays(F.array(F.lit("domain"), F.lit("node_id")), F.array(F.coalesce("_domain", F.lit("")), F.col("node_id")))
    dims = F.coalesce("dimensions", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(dims), k))
    return rows.withColumn("taxonomy_node", F.map_concat(kept, dims)).drop("_domain", "dimensions")


def first_accepted(rows: DataFrame, target: int, order: str = "ord") -> DataFrame:
    """The first ``target`` rows in arrival order, by their places: no task holds them all."""
    return numbered(rows, order).where(F.col("place") <= target).drop("place")


def unprocessed(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes that no example came from yet: what a resumed run has left to do."""
    return nodes.join(done.select("node_id").distinct(), "node_id", "left_anti")


def judge_by_tables(examples: DataFrame, screening: DataFrame, scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The default judge: verdicts (example_id, passed) and scorer replies (example_id, reply) joined to the examples."""
    rows = examples.join(screening.select("example_id", "passed"), "example_id", "left")
    rows = rows.withColumn("prefilter_score", F.when(F.coalesce("passed", F.lit(False)), 1.0).otherwise(0.0)).drop("passed")
    rows = rows.join(scores.select("example_id", F.col("reply").alias("_reply")), "example_id", "left")
    return scoring.judged(rows.withColumn("rubric", replies.parse_rubric("_reply")).drop("_reply"), "rubric", settings)


def curate(
    generated: DataFrame,
    nodes: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    target: int | None = None,
    embedder: Callable | None = None,
    stored_vectors: DataFrame | None = None,
    metric: str = "proxy_l2sq",
    settings: Settings = DEFAULTS,
    progress: Callable[[dict], None] | None = None,
    stored_bands: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Curated examples and the funnel's counters, from generator replies (node_id, reply, ord).

    Parses replies, has ``judge`` add prefilter_score, composite_score, rubric and verdict, drops near-duplicates first-wins in the
    order of ``ord``, node and place, joins the node sets, and stops at ``target``. Parsed and judged rows are written once, so that ``generated``
    and ``judge`` run once; the counters are observed while these are written. With ``settings.bands`` 0 there is no near-duplicate removal. Returned ``ord`` are places, from 1.
    """
    parsed = replies.parse_examples(generated, "reply", ("node_id", "ord")).withColumn("created_at", F.current_timestamp())
    examples = numbered(parsed, "ord", "node_id", "pos").drop("ord", "pos").withColumnRenamed("place", "ord").withColumn("ord", F.col("ord").cast("long"))
    verdicts, reasons = Observation(), Observation()
    rows = written(scoring.observe_verdicts(judge(examples), verdicts), "judged")
    good = scoring.accepted(scoring.passed(rows)).withColumn("text", shingles.dedup_text())
    good = written(good.withColumn("vector", embed.embed(F.col("text"), embedder)), "embedded")  # each text is embedded once
    told = dedup.deduplicate(good, "text", "vector", "ord", stored_vectors, metric, settings, stored_bands) if settings.bands else good.withColumn("reason", F.lit(None).cast("string"))
    told = written(scoring.observe_reasons(told, reasons), "deduplicated")
    delete(good, rows)
    counters = scoring.observed_funnel(rows.sparkSession, verdicts, reasons)
    kept = hydrate(told.where("reason is null").drop("reason"), nodes)
    if progress is not None:
        progress({f"{r['stage']}.{r['outcome']}": r["n"] for r in counters.collect()})  # a handful of rows
    return (kept if target is None else first_accepted(kept, target)), counters
