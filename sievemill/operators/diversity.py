"""Vendi diversity: the exponential of the entropy of the similarity spectrum, from a Gram matrix in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .similarity import CHUNK, matrix

PARTS = "domain string, dim int, n long, gram array<double>"


def gram_partials(rows: DataFrame) -> DataFrame:
    """domain, dim, n, gram (flat): one row per task, domain and width of ``rows`` (domain, vector); vectors scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = pa.Table.from_batches([batch.slice(at, CHUNK)])
                rows = rows.set_column(0, "domain", pc.fill_null(rows["domain"], "")).append_column("dim", pc.list_value_length(rows["vector"]))
                for key in rows.select(["domain", "dim"]).group_by(["domain", "dim"]).aggregate([]).to_pylist():
                    x = matrix(rows.filter((pc.field("domain") == key["domain"]) & (pc.field("dim") == key["dim"]))["vector"].combine_chunks())
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = x / np.where(norm > 0, norm, 1)
                    n, g = sums.get((key["domain"], key["dim"]), (0, 0.0))
                    sums[key["domain"], key["dim"]] = n + len(x), g + x.T @ x
        for (domain, dim), (n, g) in sums.items():
            gram = pa.ListArray.from_arrays(pa.array([0, g.size], pa.int32()), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([domain], pa.string()), pa.array([dim], pa.int32()), pa.array([n], pa.int64()), gram], names=["domain", "dim", "n", "gram"])

    rows = rows.select(F.col("domain").cast("string").alias("domain"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where("vector is not null and size(vector) > 0").mapInArrow(run, PARTS)


def gram_matrix(rows: DataFrame) -> DataFrame:
    """domain, dim, i, j, g: the sum over tasks; dim * dim rows per domain."""
    cells = gram_partials(rows).select("domain", "dim", "n", F.posexplode("gram").alias("at", "g"))
    cells = cells.groupBy("domain", "dim", "at").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    return cells.select("domain", "dim", "n", F.expr("at div dim").alias("i"), F.expr("at % dim").alias("j"), "g")


def _score(m: np.ndarray, n: int) -> float:
    if n < 2:
        return 0.0
    w = np.linalg.eigvalsh(m / n)
    w = w[w > 1e-12]
    return float(np.exp(-(w * np.log(w)).sum())) if len(w) else 0.0


def _scores(cells: DataFrame) -> DataFrame:
    """domain, n, score from the cells of ``gram_matrix``: a domain's d by d matrix, whatever its number of rows, goes to one task."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        n, d = int(pdf["n"].iloc[0]), int(pdf["dim"].iloc[0])
        m = np.zeros((d, d))
        m[pdf["i"], pdf["j"]] = pdf["g"]
        return pd.DataFrame({"domain": [pdf["domain"].iloc[0]], "n": [n], "score": [_score(m, n)]})

    return cells.groupBy("domain", "dim").applyInPandas(score, "domain string, n long, score double")


def vendi(rows: DataFrame) -> DataFrame:
    """domain, n, score for each domain of ``rows`` (domain, vector); 0.0 for fewer than two rows."""
    return _scores(gram_matrix(rows))


RANGE_ROWS = 16_384  # of the steps that one task goes through


def _step_scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """step, n, score of ranges that come one after the other: first a row without a step, the matrix before the range and its rows, then the range's vectors by step."""
    gram = step = None
    n, out = 0, []
    for pdf in frames:
        for (_, _, at), part in pdf.groupby([pdf["dim"], pdf["range"], pdf["step"].fillna(-1)], sort=False):
            if step is not None and at != step:
                out.append((step, n, _score(gram, n)))
                step = None
            x = np.stack(part["vector"].to_numpy()).astype(float)
            if at == -1:
                d = int(part["dim"].iloc[0])
                gram, n = x[0].reshape(d, d).copy(), int(part["n"].iloc[0])
                continue
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = x / np.where(norm > 0, norm, 1)
            gram, n, step = gram + x.T @ x, n + len(x), int(at)
        yield pd.DataFrame(out, columns=["step", "n", "score"])
        out = []
    if step is not None:
        yield pd.DataFrame([(step, n, _score(gram, n))], columns=["step", "n", "score"])


def vendi_so_far(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """step, n, score of all ``rows`` (step >= 0, vector) up to each step.

    Steps are cut into ranges of about ``range_rows`` rows. The ranges' matrices add up in order; a task starts from the matrix before its range and adds the vectors of the range's
    steps one step after the other. So a matrix travels for each range, not for each step, and a task holds one. A step that is a range by itself needs no vectors for that.
    """
    rows = rows.where("vector is not null and size(vector) > 0").select(F.col("step").cast("long").alias("step"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    sizes = rows.groupBy("dim", "step").agg(F.count("*").alias("rows"))  # a row for each step
    mid = F.sum("rows").over(W.partitionBy("dim").orderBy("step").rowsBetween(W.unboundedPreceding, 0)) - F.expr("rows div 2")
    ranges = sizes.withColumn("range", F.floor(mid / range_rows).cast("long")).withColumn("alone", F.count("*").over(W.partitionBy("dim", "range")) == 1).drop("rows")
    placed = rows.join(ranges, ["dim", "step"])
    cells = gram_matrix(placed.select(F.col("range").cast("string").alias("domain"), "vector")).withColumn("range", F.col("domain").cast("long"))
    order = W.partitionBy("dim", "i", "j").orderBy("range")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    cells = cells.select("range", "dim", "i", "j", F.sum("g").over(upto).alias("g"), F.sum("n").over(upto).alias("n"), zero("g", before).alias("g0"), zero("n", before).alias("n0"))
    whole = _scores(cells.join(ranges.where("alone").select("dim", "range", F.col("step").cast("string").alias("domain")), ["dim", "range"]))
    shared = cells.join(ranges.where("not alone").select("dim", "range").distinct(), ["dim", "range"])
    first = shared.groupBy("dim", "range").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "g0"))), lambda x: x["g0"]).alias("vector"), F.max("n0").alias("n"))
    both = first.select("dim", "range", F.lit(None).cast("long").alias("step"), "n", "vector").unionByName(placed.where("not alone").select("dim", "range", "step", F.lit(None).cast("long").alias("n"), "vector"))
    parts = both.repartition("dim", "range").sortWithinPartitions("dim", "range", F.col("step").asc_nulls_first())
    return parts.mapInPandas(_step_scores, "step long, n long, score double").unionByName(whole.select(F.col("domain").cast("long").alias("step"), "n", "score"))


def vendi_history(manifest: DataFrame) -> DataFrame:
    """domain, run_id, accepted_count, vendi_score of all checkpoints, in order."""
    return manifest.select("domain", "run_id", "accepted_count", "vendi_score").orderBy("domain", "run_id", "accepted_count")
