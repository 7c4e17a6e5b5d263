"""Continuous curation: the same steps on a stream of files, with the stored corpus as the state."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..functions import replies
from ..operators import requests, scoring
from ..plans.curate import curate
from ..sources import band_index, tables
from ..sources.storage import delete, exists, written


class TargetMet(Exception):
    """Raised by a batch that comes after the target: it stays unread, and a later query with a higher target begins with it."""


class Curation:
    """A running curation: ``query`` is Spark's own; ``awaitTermination`` ends it after the batch that met the target."""

    def __init__(self) -> None:
        self.query: StreamingQuery | None = None
        self.met_at: int | None = None

    def awaitTermination(self, timeout: float | None = None, every: float = 0.5) -> bool:
        """True once the query has ended: by itself, or by the target. With ``timeout`` (seconds) False if it hasn't by then."""
        waited = 0.0
        while True:
            try:
                if self.query.awaitTermination(every):
                    return True
            except StreamingQueryException:
                if self.met_at is None:
                    raise
                return True
            done = self.query.lastProgress
            if self.met_at is not None and done is not None and done["batchId"] >= self.met_at:
                self.query.stop()
                return True
            waited += every
            if timeout is not None and waited >= timeout:
                return False


def curate_stream(
    stream: DataFrame,
    nodes: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    target: int | None = None,
    settings: Settings = DEFAULTS,
    embedder: Callable | None = None,
    once: bool = True,
    name: str = "stream",
    metric: str = "proxy_l2sq",
    progress: Callable[[dict], None] | None = None,
) -> Curation:
    """Run ``curate`` on each micro-batch against everything kept so far, and write what stays.

    A batch is a step: its folders of ``jsonl``, ``kept`` (examples), ``vectors`` and ``bands`` in ``out`` come first, its row of ``manifest`` last (domain ``name``, accepted and
    rejected counts of all batches so far). Only steps with a manifest row count: a batch that broke off replaces its folders, and one that is repeated after its manifest row is skipped.
    Near-duplicates of what was kept go by the stored bands and vectors; nothing kept is counted or signed again. The batch that reaches ``target`` is cut, and
    the query ends after it, so that later files stay unread. ``progress`` is told each batch's number and counters, which are observed while the batch is written.
    """
    spark = stream.sparkSession
    manifest, run, own = f"{out}/manifest", Curation(), f"{zlib.crc32(checkpoint.encode()):08x}"

    def step(batch: DataFrame, number: int) -> None:
        done = tables.read_manifest(spark, manifest).where(F.col("domain") == name)
        step_name = f"{name}-{own}-{number:09d}"
        sums = done.agg(F.coalesce(F.max("accepted_count"), F.lit(0)), F.coalesce(F.max("rejected_count"), F.lit(0)), F.coalesce(F.max(F.col("extra")["step"] == step_name), F.lit(False)))
        accepted, rejected, written_before = sums.first()
        if not written_before:
            if target is not None and accepted >= target:
                run.met_at = number - 1
                raise TargetMet(f"{accepted} examples of {target}")
            steps = tables.committed_steps(spark, manifest, name)
            vectors = tables.stored_vectors(spark, f"{out}/vectors", None, steps).select("id", "vector") if accepted else None
            bands = band_index.read_bands(spark, f"{out}/bands", steps) if accepted and settings.bands else None
            told = None if progress is None else lambda counts: progress({"batch": number, **counts})
            rows, counters = curate(batch, nodes, judge, None if target is None else target - accepted, embedder, vectors, metric, settings, told, bands)
            if accepted:
                stored = tables.of_steps(spark.read.schema(tables.STEP_EXAMPLES).parquet(f"{out}/kept"), steps)
                rows = rows.join(stored.select("example_id"), "example_id", "left_anti")
            rows = written(rows, "accepted")
            accepted += rows.count()
            rejected += counters.where("stage <> 'done'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            domain = F.coalesce(F.col("taxonomy_node")["domain"], F.lit(""))
            tables.write_jsonl(rows, f"{out}/jsonl", step_name)
            tables.write_examples(rows, f"{out}/kept", step_name)
            tables.write_vectors(rows.select(F.col("example_id").alias("id"), "vector", "composite_score", domain.alias("domain")), f"{out}/vectors", settings.embedding_dim, step_name)
            if settings.bands:
                band_index.write_bands(band_index.text_buckets(rows.withColumnRenamed("example_id", "id"), "id", "text", settings), f"{out}/bands", step_name)
            extra = F.create_map(F.lit("step"), F.lit(step_name), F.lit("batch"), F.lit(str(number)))
            row = spark.range(1).select(
                tables.run_id(F.lit(name)).alias("run_id"), F.lit(name).alias("domain"), F.lit(target).cast("long").alias("target"), F.lit(accepted).alias("accepted_count"),
                F.lit(rejected).alias("rejected_count"), F.current_timestamp().alias("timestamp"), extra.alias("extra"),
            )
            tables.append_manifest(row.coalesce(1), manifest)
            delete(rows)
        if target is not None and accepted >= target:
            run.met_at = number

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    run.query = (writer.trigger(availableNow=True) if once else writer).start()
    return run


def screen_stream(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], partition: str, order: list[str], out: str, checkpoint: str):
    """Screen the examples of each micro-batch in batches and write them, with prefilter_score, to ``out``.

    ``answer`` turns the requests of a micro-batch into replies (request_id, reply); what has no verdict in a reply fails. A micro-batch that is run again
    replaces its own rows.
    """

    def step(rows: DataFrame, number: int) -> None:
        keys = [partition, "batch"]
        batched = requests.screening_batches(rows, partition, order)
        told = batched.groupBy(*keys).agg(F.count("*").cast("int").alias("size"))
        told = told.withColumn("request_id", requests.screening_id(partition))
        told = told.join(answer(requests.screening_requests(batched, partition)).select("request_id", "reply"), "request_id", "left")
        verdicts = replies.parse_verdicts(told, "reply", keys, "size")
        scoring.screened(batched, verdicts, keys).write.mode("overwrite").parquet(f"{out}/micro={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, keys: list[str], name: str):
    """Live counters by ``keys`` in an in-memory table, until the stream has no more files."""
    counts = stream.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()


def running_coverage(stream: DataFrame, name: str, column: str = "dimensions"):
    """Coverage of every taxonomy value so far."""
    return running_counts(stream.select(F.explode(column).alias("dimension", "value")), ["dimension", "value"], name)


def first_seen(stream: DataFrame, key: str, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose ``key`` comes for the first time: for ever, or within a watermark on ``event_time``."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
