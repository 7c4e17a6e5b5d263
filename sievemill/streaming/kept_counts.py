"""Counters of a stream that are kept as a table: no state in Spark's store, nothing on the driver, and a restart repeats nothing.

What a batch adds is a folder of its own, ``batch=<number>``, which a repetition of the batch replaces. From time to time base and
batches are folded into a new base, ``base=<last batch in it>``. A reader takes the newest base whose write has ended and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import complete_folders, remove


def _folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The batches of all complete bases, and those of all complete deltas, in order."""
    names = complete_folders(spark, path)
    of = lambda kind: [int(n.removeprefix(kind)) for n in names if n.startswith(kind)]
    return of("base="), of("batch=")


def _base(path: str, number: int) -> str:
    return f"{path}/base={number:012d}"


def _batch(path: str, number: int) -> str:
    return f"{path}/batch={number:012d}"


def read_counts(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """The columns ``keys`` (as in "dimension string, value string") and n, over all batches so far; no row if there is none."""
    bases, batches = _folders(spark, path)
    upto = bases[-1] if bases else -1
    parts = [_base(path, upto)] * bool(bases) + [_batch(path, b) for b in batches if b > upto]
    schema = f"{keys}, n bigint"
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def add_batch(rows: DataFrame, keys: str, path: str, number: int, fold_every: int = 50) -> None:
    """Add the rows of batch ``number``, counted by ``keys``; a batch that comes again replaces its counts, or is skipped if a base has it already.

    Null keys are values like others. After ``fold_every`` batches a new base is written, and what only the base before the last one needed is
    deleted: a reader that has begun keeps its files till the next time.
    """
    spark = rows.sparkSession
    names = [f.name for f in spark.createDataFrame([], keys).schema]
    bases, _ = _folders(spark, path)
    if bases and number <= bases[-1]:
        return
    rows.groupBy(*names).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(_batch(path, number))
    bases, batches = _folders(spark, path)
    upto = bases[-1] if bases else -1
    if sum(b > upto for b in batches) >= fold_every:
        read_counts(spark, path, keys).write.mode("overwrite").parquet(_base(path, batches[-1]))
        remove(spark, *[_base(path, b) for b in bases[:-1]], *[_batch(path, b) for b in batches if b <= upto])


def count_stream(stream: DataFrame, keys: str, path: str, checkpoint: str, once: bool = True, fold_every: int = 50) -> StreamingQuery:
    """Count the rows of ``stream`` by ``keys`` into the table at ``path``, which belongs to this ``checkpoint`` alone."""

    def step(batch: DataFrame, number: int) -> None:
        add_batch(batch, keys, path, number, fold_every)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


COVERAGE = "dimension string, value string"


def coverage_stream(stream: DataFrame, path: str, checkpoint: str, column: str = "dimensions", once: bool = True, fold_every: int = 50) -> StreamingQuery:
    """Coverage of every taxonomy value so far, of a map column; null values are left out, as in ``operators.coverage``."""
    values = stream.select(F.explode(column).alias("dimension", "value")).where("value is not null")
    return count_stream(values, COVERAGE, path, checkpoint, once, fold_every)


def kept_coverage(spark: SparkSession, path: str) -> DataFrame:
    """dimension, value, n of a table that ``coverage_stream`` keeps: what ``operators.coverage.gaps`` takes."""
    return read_counts(spark, path, COVERAGE)
