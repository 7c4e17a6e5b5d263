"""Nearest neighbours by an inverted-cell index: vectors go to the cell of their nearest centroid, and a query looks into few cells.

A cell knows its radius, so that the triangle inequality bounds what it can hold for a query. That makes the index exact where exactness is asked for: cells that
can't beat what was found, or can't reach a threshold, are left out, and no other. Nothing but the centroids and one row a cell passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import delete, exists, written
from ..sources.tables import of_steps
from .similarity import CHUNK, SIDES, block_rows, gathered, ranked, score_of

SLACK = 1e-6  # of distances, for rounding
ROWS = "cell int, id string, vector array<double>, distance double, step string"


@dataclass
class VectorIndex:
    """``rows``: cell, id, vector, distance (to the cell's centroid)."""

    centroids: np.ndarray
    rows: DataFrame
    metric: str


def _points(vectors: pd.Series, metric: str) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
    return x


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0))


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Few rows at a time, since a task holds the distance of each to every cell."""
    for p in range(0, len(pdf), CHUNK):
        yield pdf.iloc[p : p + CHUNK]


def _best_possible(distance: np.ndarray, metric: str) -> np.ndarray:
    """The similarity of two points at least ``distance`` apart is at most this."""
    return 1 - distance**2 / 2 if metric == "cosine" else 1 / (1 + distance**2)


def fit_centroids(vectors: DataFrame, metric: str = "proxy_l2sq", cells: int | None = None, per_cell: int = 32, most_cells: int = 4096, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds over a sample of about ``cells`` * ``per_cell`` rows of ``vectors`` (id, vector), chosen by a hash of the id.

    ``cells`` is the root of the number of rows, ``most_cells`` at most. The sample decides how fast the index is, never what it holds. No vector gives no centroid.
    """
    rows = vectors.where("vector is not null and size(vector) > 0")
    n = rows.count()
    cells = max(1, min(most_cells, math.isqrt(n) if cells is None else cells))
    one_in = max(1, n // (cells * per_cell))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(one_in)) == 0) if one_in > 1 else rows
    pdf = sample.select(F.xxhash64("id").alias("h"), F.col("vector").cast("array<double>").alias("vector")).toPandas()  # per_cell rows a cell or so
    if not len(pdf):
        return np.zeros((0, 1))
    x = _points(pdf.sort_values("h", kind="stable")["vector"], metric)
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(1).permutation(len(c))[:cells]]
    for _ in range(rounds):
        at = np.concatenate([_distances(part, c).argmin(axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        size = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = "proxy_l2sq") -> DataFrame:
    """cell, id, vector, distance of every row of ``vectors`` (id, vector) that has a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # most_cells rows at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in _chunks(pdf):
                d = _distances(_points(part["vector"], metric), shared.value)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": part["id"], "vector": part["vector"], "distance": d[np.arange(len(d)), cell]})

    return _with_vector(vectors).mapInPandas(run, f"cell int, id {dict(vectors.dtypes)['id']}, vector array<double>, distance double")


def build(vectors: DataFrame, metric: str = "proxy_l2sq", cells: int | None = None) -> VectorIndex:
    """An index of all rows of ``vectors`` (id, vector) that have a vector."""
    centroids = fit_centroids(vectors, metric, cells)
    return VectorIndex(centroids, written(assign(vectors, centroids, metric).repartitionByRange("cell").sortWithinPartitions("cell"), "index"), metric)


def write_index(vectors: DataFrame, path: str, step: str, metric: str = "proxy_l2sq") -> None:
    """Add a step's vectors (id, vector) to the index at ``path``; the first step that has vectors fits the centroids, a repeated step replaces its rows."""
    spark = vectors.sparkSession
    if not exists(spark, f"{path}/centroids/_SUCCESS"):
        c = fit_centroids(vectors, metric)
        if not len(c):
            return
        spark.createDataFrame([(i, x.tolist(), metric) for i, x in enumerate(c)], "cell int, centroid array<double>, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    index = read_index(spark, path)
    rows = assign(vectors.withColumn("id", F.col("id").cast("string")), index.centroids, index.metric)
    rows.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows/step={step}")  # a cell's rows lie together


def read_index(spark: SparkSession, path: str, steps: DataFrame | None = None) -> VectorIndex:
    """The index at ``path``, of the given ``steps`` (step) or of all."""
    c = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    if exists(spark, f"{path}/rows"):
        rows = of_steps(spark.read.schema(ROWS).parquet(f"{path}/rows"), steps)
    else:
        rows = spark.createDataFrame([], ROWS)
    return VectorIndex(np.stack(c["centroid"].to_numpy()), rows.select("cell", "id", "vector", "distance"), c["metric"].iloc[0])


Choice = Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray]  # distances to cells and bounds, [rows, cells], and the rows: which cells to look into


def _sizes(index: VectorIndex) -> pd.DataFrame:
    return index.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).orderBy("cell").toPandas()  # a row a cell


def _parts(sizes: pd.DataFrame, most: int) -> np.ndarray:
    """The part of each cell: cells in a row, of about a ``SIDES``-th of the rows together, and of more than ``most`` only where one cell has more."""
    full = min(most, max(2 * CHUNK, -(-int(sizes["n"].sum()) // SIDES)))
    part, rows, out = 0, 0, []
    for n in sizes["n"].tolist():  # a row a cell
        if rows and rows + n > full:
            part, rows = part + 1, 0
        out.append(part)
        rows += n
    return np.array(out)


def _looked_up(rows: DataFrame, index: VectorIndex, sizes: pd.DataFrame, choose: Choice, block: int | None) -> DataFrame:
    """id, other, similarity, cell: the best of each part of the cells that each row of ``rows`` (id, vector and what ``choose`` needs) looks into.

    A row travels once to each part that has a cell chosen for it, with a bit for each cell there, not once to each cell. A part of many rows, or one asked by many, is cut into
    blocks of about ``block`` rows on either side (by default as many as hold ``similarity.NUMBERS`` numbers).
    """
    spark, metric = rows.sparkSession, index.metric
    numbers, most = sizes["cell"].to_numpy(), block or block_rows(index.centroids.shape[1])
    part = _parts(sizes, most)
    shared = spark.sparkContext.broadcast((index.centroids[numbers], sizes["radius"].to_numpy(), part))  # a row a cell

    def chosen(pdf: pd.DataFrame) -> np.ndarray:
        centroids, radius, _ = shared.value
        d = _distances(_points(pdf["vector"], metric), centroids)
        return choose(d, _best_possible(np.maximum(d * (1 - SLACK) - radius * (1 + SLACK) - SLACK, 0), metric), pdf)

    def used(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        any_ = [chosen(x).any(axis=0) for pdf in frames for x in _chunks(pdf)]
        if any_:
            yield pd.DataFrame({"cells": [np.packbits(np.any(any_, axis=0)).tobytes()]})

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = shared.value[2]
        for pdf in frames:
            for x in _chunks(pdf):
                mask = chosen(x)
                for k in range(part[-1] + 1):
                    bits = mask[:, part == k]
                    some = bits.any(axis=1)
                    if some.any():
                        yield pd.DataFrame({"part": np.int32(k), "id": x["id"].to_numpy()[some], "vector": x["vector"].to_numpy()[some], "cells": [b.tobytes() for b in np.packbits(bits[some], axis=1)]})

    kinds = dict(rows.dtypes)["id"], dict(index.rows.dtypes)["id"]
    none = spark.createDataFrame([], f"id {kinds[0]}, other {kinds[1]}, similarity double, cell int")
    asked = [np.unpackbits(np.frombuffer(r[0], dtype=np.uint8), count=len(numbers)) for r in rows.mapInPandas(used, "cells binary").collect()]  # a bit a cell from each task
    asked = np.any(asked, axis=0) if asked else np.zeros(len(numbers), dtype=bool)
    if not asked.any():
        return none
    ni = max(1, -(-rows.count() // most))
    told = sizes.assign(part=part)[asked]
    nj = (-(-told.groupby("part")["n"].sum() // most)).to_dict()
    blocks = spark.createDataFrame([(int(c), int(p), int(nj[p])) for c, p in zip(told["cell"], told["part"], strict=True)], "cell int, part int, nj int")  # a row a cell
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    no = lambda k: F.lit(None).cast(k)
    q = rows.mapInPandas(sent, f"part int, id {kinds[0]}, vector array<double>, cells binary").join(F.broadcast(blocks.select("part", "nj").distinct()), "part")
    q = q.select("part", at(F.lit(ni)).alias("i"), every(F.col("nj")).alias("j"), "id", no(kinds[1]).alias("other"), "vector", "cells", no("int").alias("cell"))
    r = index.rows.where(F.col("cell").isin(told["cell"].tolist())).join(F.broadcast(blocks), "cell")
    r = r.select("part", every(F.lit(ni)).alias("i"), at(F.col("nj")).alias("j"), no(kinds[0]).alias("own"), F.col("id").alias("other"), "vector", no("binary").alias("cells"), "cell").withColumnRenamed("own", "id")

    def tile(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held = [], []
        for batch in batches:
            of_index = pc.is_valid(batch.column("cell"))
            queries.append(batch.filter(pc.invert(of_index)))
            held.append(batch.filter(of_index))
        if not any(x.num_rows for x in queries) or not any(x.num_rows for x in held):
            return
        (one, a), (two, b) = gathered(queries, ["id", "cells"]), gathered(held, ["other", "cell"])
        del queries, held
        order = pc.sort_indices(pa.table(two), sort_keys=[("cell", "ascending"), ("other", "ascending")])
        others, cell, b = two["other"].take(order), two["cell"].take(order).to_numpy(), b[order.to_numpy()]
        ids = one["id"]
        codes = pa.concat_arrays([ids, others]).dictionary_encode().indices.to_numpy() if ids.type == others.type else np.arange(len(ids) + len(others))
        ca, cb = codes[: len(ids)], codes[len(ids) :]
        mine = numbers[part == key[0].as_py()]
        looks = np.unpackbits(np.stack([np.frombuffer(x, dtype=np.uint8) for x in one["cells"].to_pylist()]), axis=1, count=len(mine)).astype(bool)
        ra, rb = ranked(a, b, metric)
        best, where = np.full(len(a), -np.inf), np.zeros(len(a), dtype=np.int64)
        for k, c in enumerate(mine):
            low, high = np.searchsorted(cell, [c, c + 1])
            asking = np.flatnonzero(looks[:, k]) if high > low else []
            for p in range(0, len(asking), CHUNK):
                at = asking[p : p + CHUNK]
                for s0 in range(low, high, CHUNK):
                    s = ra[at] @ rb[s0 : min(high, s0 + CHUNK)].T
                    s[ca[at, None] == cb[None, s0 : min(high, s0 + CHUNK)]] = -np.inf
                    first = s.argmax(axis=1)
                    top = s[np.arange(len(s)), first]
                    better = top > best[at]
                    best[at[better]], where[at[better]] = top[better], first[better] + s0
        ok = np.isfinite(best)
        found = pa.array(where[ok])
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), others.take(found), pa.array(score_of(best, a, metric)[ok]), pa.array(cell[where[ok]].astype(np.int32))], names=["id", "other", "similarity", "cell"])

    return q.unionByName(r).groupBy("part", "i", "j").applyInArrow(tile, none.schema)


def _with_vector(rows: DataFrame) -> DataFrame:
    return rows.where("vector is not null and size(vector) > 0").select("id", F.col("vector").cast("array<double>").alias("vector"))


def probes_for(rows: DataFrame, index: VectorIndex, recall: float = 0.95, sample: int = 256, block: int | None = None) -> int:
    """In how many of its nearest cells a row has to look, so that ``recall`` of a sample of ``rows`` (id, vector) find their nearest vector.

    The sample of about ``sample`` rows, chosen by a hash of the id, looks into all cells. 1 where no row of it has a neighbour.
    """
    asked, sizes = _with_vector(rows), _sizes(index)
    one_in = max(1, asked.count() // sample)
    some = written(asked.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(one_in)) == 0), "sample")
    if not len(sizes) or not some.limit(1).count():
        return 1
    found = _looked_up(some, index, sizes, lambda d, bound, _: np.ones(d.shape, dtype=bool), block)
    best = found.groupBy("id").agg(F.max_by("cell", "similarity").alias("cell")).join(some, "id").select("vector", "cell").toPandas()  # the sample
    delete(some)
    if not len(best):
        return 1
    d = _distances(_points(best["vector"], index.metric), index.centroids[sizes["cell"].to_numpy()])
    at = np.searchsorted(sizes["cell"].to_numpy(), best["cell"].to_numpy())
    place = (d <= d[np.arange(len(d)), at][:, None]).sum(axis=1)
    return int(np.sort(place)[math.ceil(recall * len(place)) - 1])


def nearest(rows: DataFrame, index: VectorIndex, probes: int | None = None, exact: bool = False, at_least: float | None = None, recall: float = 0.95, block: int | None = None) -> DataFrame:
    """id, similarity of each row of ``rows`` (id unique, vector) to the nearest indexed vector with another id; 0.0 where there is none.

    Each row looks into its ``probes`` nearest cells, by default as many as ``probes_for`` finds for ``recall``. Rows that find nothing there, and with ``exact`` all rows,
    look also into every cell whose bound exceeds what they found. With ``at_least`` a row looks into all cells that may hold a vector as similar as that, and no others: a
    similarity from there on is exact, and a smaller one is that of what was seen. Rows without a vector have 0.0. Vectors of another width than the index's fail.
    """
    sizes = _sizes(index)
    if not len(sizes):
        return rows.select("id", F.lit(0.0).alias("similarity"))
    if probes is None and at_least is None:
        probes = 1 if exact else probes_for(rows, index, recall, block=block)

    def first(d: np.ndarray, bound: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        if at_least is not None:
            return bound >= at_least
        mask = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(mask, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
        return mask

    def more(d: np.ndarray, bound: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
        return ~first(d, bound, pdf) & (bound > pdf["similarity"].fillna(-np.inf).to_numpy()[:, None])

    asked = _with_vector(rows)
    best = lambda found: found.groupBy("id").agg(F.max("similarity").alias("similarity"))
    found = written(best(_looked_up(asked, index, sizes, first, block)), "nearest")
    if at_least is None:
        rest = asked.join(found, "id", "left")
        rest = rest if exact else rest.where("similarity is null")
        again = _looked_up(rest, index, sizes, more, block)
        both = written(best(found.unionByName(again.select("id", "similarity"))) if exact else found.unionByName(best(again)), "nearest")
        delete(found)
        found = both
    return rows.select("id").join(found, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
