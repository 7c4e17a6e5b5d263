"""A whole run for one domain: size, sample, resume, curate, write, checkpoint, wave by wave."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import diversity, requests, sampling, similarity
from ..sources import band_index, tables
from ..sources.storage import exists, numbered, written
from .curate import curate


def next_wave(needed: int, asked: int, accepted: int, left: int, batch: int = DEFAULTS.generator_batch) -> int:
    """How many node sets to ask next: half as many again as full replies would take at first, then a tenth more than the acceptance so far takes.

    As long as nothing was accepted the waves double. At most ``left``; 0 once nothing is needed.
    """
    if needed <= 0 or left <= 0:
        return 0
    if not asked:
        size = -(-3 * needed // (2 * batch))
    else:
        size = 2 * asked if not accepted else -(-11 * needed * asked // (10 * accepted))
    return max(1, min(size, left))


def checkpoints(placed: DataFrame, before: DataFrame, every: int, steps: int) -> DataFrame:
    """step, last_node_idx, taxonomy_coverage, vendi_score after each ``every`` accepted rows.

    ``placed`` has place, idx, taxonomy_node, vector; ``before`` (taxonomy_node, vector) is what earlier runs accepted.
    """
    new = placed.select(F.ceil(F.col("place") / every).cast("long").alias("step"), "idx", "taxonomy_node", "vector")
    all_ = new.unionByName(before.select(F.lit(0).cast("long").alias("step"), F.lit(None).cast("long").alias("idx"), "taxonomy_node", "vector"))
    marks = all_.sparkSession.range(1, steps + 1).withColumnRenamed("id", "step")
    so_far = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)  # a row for each step
    idx = marks.join(all_.groupBy("step").agg(F.max("idx").alias("idx")), "step", "left").select("step", F.max("idx").over(so_far).alias("last_node_idx"))
    values = all_.select("step", F.explode("taxonomy_node").alias("dimension", "value")).where("dimension not in ('domain', 'node_id')")
    seen = values.groupBy("step", F.concat_ws("=", "dimension", "value").alias("key")).agg(F.count("*").alias("n"))
    grown = seen.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by"), F.min(F.greatest("step", F.lit(1))).alias("from"))
    grown = grown.select("key", F.explode(F.expr(f"sequence(`from`, {steps}L)")).alias("step"), "by")
    count = lambda step: F.coalesce(F.col("by")[step], F.lit(0))
    more = count(F.col("step")) + F.when(F.col("step") == 1, count(F.lit(0).cast("long"))).otherwise(0)  # what came before counts from the first step on
    seen = grown.select("step", "key", F.sum(more).over(W.partitionBy("key").orderBy("step").rowsBetween(W.unboundedPreceding, 0)).alias("n"))
    seen = seen.groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("taxonomy_coverage"))  # the taxonomy's values
    score = diversity.vendi_so_far(all_).select("step", F.col("score").alias("vendi_score"))
    return idx.join(seen, "step", "left").join(score, "step", "left")


def run_domain(
    taxonomy: DataFrame,
    domain: str,
    target: int,
    generate: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    out: str,
    min_coverage: int = DEFAULTS.min_coverage,
    seed: int = 0,
    ad_hoc: bool = False,
    use_case: str | None = None,
    embedder: Callable | None = None,
    metric: str = "proxy_l2sq",
    settings: Settings = DEFAULTS,
    progress: Callable[[dict], None] | None = None,
    layer1_scope: str = "run",
) -> DataFrame:
    """The manifest rows of a run that brings ``domain`` to ``target`` accepted examples.

    Scenarios are asked in waves, in the order of their numbers: ``generate`` answers a wave's requests (node_id, reply, ord), the replies
    are curated against all stored vectors of the domain, and the next wave is as large as the acceptance so far demands. The run ends at the target, or
    when as many scenarios were asked as ``plan_size`` allows. A later run goes on with the number after the last one asked.

    ``layer1_scope``: texts are held against the texts accepted by this `run`, or by all runs of all domains in ``out`` (`corpus`).

    A wave is a step: it writes its folders of ``jsonl``, ``examples``, ``vectors`` and ``bands`` in ``out``, and last of all its rows of ``manifest``. Only steps with a manifest row
    count; one that broke off is asked again and its folders are replaced. A manifest row stands after every ``settings.checkpoint_every``
    accepted examples of a wave and at its end, where it has the run's rejected rows so far. A run whose target is met already writes one row and nothing else.
    """
    if layer1_scope not in ("run", "corpus"):
        raise ValueError(f"layer1_scope is neither run nor corpus: {layer1_scope!r}")
    spark = taxonomy.sparkSession
    manifest, bands = f"{out}/manifest", f"{out}/bands"
    largest = taxonomy.groupBy("dimension").count().agg(F.max("count")).first()[0] or 1
    at = spark.range(1).select(tables.run_id(F.lit(domain)).alias("run_id"), F.date_trunc("millisecond", F.current_timestamp()).alias("at")).first()
    known = tables.read_manifest(spark, manifest).where(F.col("domain") == domain)
    first, step = known.agg(F.coalesce(F.max(F.col("extra")["asked_to"].cast("long")), F.lit(0)), F.countDistinct(F.col("extra")["step"])).first()
    before = _accepted_before(spark, out, domain)
    have = before.count()
    n, cover = sampling.plan_size(max(1, target - have), min_coverage, largest, ad_hoc)
    if have < target and (bad := sampling.infeasible(taxonomy, first + n, cover).first()):
        raise sampling.CoverageError(f"dimension {bad['dimension']!r} needs {bad['needed']} rows, there are {first + n}")
    own_name = f"{re.sub('[^A-Za-z0-9_-]', '_', domain)[:40]}-{zlib.crc32(domain.encode()):08x}"
    asked = accepted = rejected = wave = 0
    while True:
        size = next_wave(target - have, asked, accepted, n - asked, settings.generator_batch)
        if not size and wave:
            break
        name, m = f"{own_name}-{step:06d}", 0
        placed = _none(spark).withColumn("idx", F.lit(None).cast("long")).withColumn("place", F.lit(None).cast("long"))
        if size:
            nodes = sampling.sample_node_sets(taxonomy, domain, first + asked + size, cover, seed, strict=False, use_case=use_case, start=first + asked)
            replies = generate(requests.generation_requests(nodes, settings.generator_batch))
            vectors = before.where("vector is not null").select(F.col("example_id").alias("id"), "vector") if have else None
            known = None
            if layer1_scope == "corpus":
                known = band_index.read_bands(spark, bands, tables.committed_steps(spark, manifest))
            elif wave:
                known = band_index.read_bands(spark, bands, tables.committed_steps(spark, manifest, domain), f"{at['run_id']} {at['at']}")
            kept, counters = curate(replies, nodes, judge, target - have, embedder, vectors, metric, settings, progress, known)
            kept = written(kept.join(before.select("example_id"), "example_id", "left_anti"), "accepted")
            m = kept.count()
            rejected += counters.where("stage <> 'done'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            ids = kept.select(F.col("example_id").alias("id"), "vector")
            near = similarity.nearest_similarity(ids, ids if vectors is None else ids.unionByName(vectors.withColumn("vector", F.col("vector").cast(ids.schema["vector"].dataType))), metric)
            own = F.coalesce(F.col("taxonomy_node")["domain"], F.lit(""))
            tables.write_jsonl(kept.join(near.select(F.col("id").alias("example_id"), F.col("similarity").alias("nearest_neighbor_similarity")), "example_id"), f"{out}/jsonl", name)
            tables.write_vectors(kept.select(F.col("example_id").alias("id"), "vector", "composite_score", own.alias("domain")), f"{out}/vectors", settings.embedding_dim, name)
            tables.write_examples(kept, f"{out}/examples", name)
            if settings.bands:
                band_index.write_bands(band_index.text_buckets(kept.withColumnRenamed("example_id", "id"), "id", "text", settings), bands, name, f"{at['run_id']} {at['at']}")
            placed = numbered(kept, "ord").join(nodes.select("node_id", "idx"), "node_id", "left")
            placed = placed.withColumn("vector", F.col("vector").cast("array<float>"))
            asked, accepted = asked + size, accepted + m
        every = settings.checkpoint_every
        steps = max(1, math.ceil(m / every))
        marks = spark.range(1, steps + 1).select(F.col("id").alias("step"), F.least(F.col("id") * every, F.lit(m)).alias("new"))
        rows = marks.join(checkpoints(placed, before, every, steps), "step", "left")
        extra = {"seed": seed, "wave": wave + 1, "asked": size, "asked_to": first + asked, **({"step": name} if size else {})}
        rows = rows.select(
            F.lit(at["run_id"]).alias("run_id"), F.lit(domain).alias("domain"), F.lit(target).alias("target"), (F.col("new") + have).alias("accepted_count"),
            F.when(F.col("step") == steps, F.lit(rejected)).alias("rejected_count"), "last_node_idx", "vendi_score", "taxonomy_coverage", F.lit(at["at"]).alias("timestamp"),
            F.create_map(*[F.lit(str(x)) for pair in extra.items() for x in pair]).alias("extra"),
        )
        tables.append_manifest(rows.coalesce(1), manifest)  # one file: all of a step's rows or none
        have, step, wave = have + m, step + 1, wave + 1
        if not size or have >= target or asked >= n:
            break
        before = _accepted_before(spark, out, domain)
    return tables.read_manifest(spark, manifest).where((F.col("run_id") == at["run_id"]) & (F.col("timestamp") == at["at"]))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "example_id string, node_id string, taxonomy_node map<string,string>, vector array<float>")


def _accepted_before(spark: SparkSession, out: str, domain: str) -> DataFrame:
    """example_id, node_id, taxonomy_node, vector of what a domain's steps have accepted so far."""
    if not (exists(spark, f"{out}/examples") and exists(spark, f"{out}/vectors")):
        return _none(spark)
    steps = tables.committed_steps(spark, f"{out}/manifest", domain)
    old = tables.step_examples(spark, f"{out}/examples", domain, steps)
    vectors = tables.stored_vectors(spark, f"{out}/vectors", domain, steps).select(F.col("id").alias("example_id"), "vector")
    return written(old.join(vectors, "example_id", "left"), "before")
