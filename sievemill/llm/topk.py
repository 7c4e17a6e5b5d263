"""Exact top-k inner-product search by tiles: blocks of queries times shards of vectors, top k of each tile, tree merge."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def integer_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null or holds null or non-finite ones."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products. Float64 BLAS is exact below 2**53; larger components take integer arithmetic."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    query_block: int = 2048,
    shard_rows: int = 8192,
    fan_in: int = 16,
) -> DataFrame:
    """The ``k`` highest scores of every query among all vectors with another id, ties to the smaller id.

    ``vectors`` and ``queries`` have vec_id long and q array<long> (not null, of one width; other widths never meet).
    Tiles are (query block, shard) pairs dealt over the cluster; their sizes bound a task's memory. A tile returns at
    most ``k`` rows per query, and levels of ``fan_in`` lists each are merged until one is left. Rows with a null
    id take no part; of rows that repeat an id each is a candidate, and the one with the least vector is the query. Other
    columns are ignored. Returns query_id, rank, vec_id, score.
    """
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    vectors, queries = (d.where("vec_id is not null").withColumn("width", F.size("q")) for d in (vectors, queries))
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // query_block))
    left = queries.select(
        "vec_id", "q", "width", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
    )
    right = vectors.select(
        F.col("vec_id").alias("other_id"), F.col("q").alias("other_q"), "width", F.pmod(F.xxhash64("vec_id", F.col("q")), F.lit(n_shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
    )

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "shard": [], "vec_id": [], "score": []}).astype("int64")
        if not len(a) or not len(b):
            return none
        ids = b["other_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, other = ids[order], np.stack(b["other_q"].to_numpy()[order])
        out = []
        step = max(1, 4_000_000 // len(ids))
        mine, own = np.stack(a["q"].to_numpy()), a["vec_id"].to_numpy()
        lowest = np.iinfo(np.int64).min
        for i in range(0, len(own), step):
            s = _scores(mine[i : i + step], other)
            self_ = own[i : i + step, None] == ids[None, :]
            s[self_] = lowest
            kk = min(k, s.shape[1])
            bar = np.partition(s, s.shape[1] - kk, axis=1)[:, -kk]
            for r in range(len(s)):
                over = np.flatnonzero((s[r] >= bar[r]) & ~self_[r])
                best = over[np.argsort(-s[r, over], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": own[i + r], "shard": b["shard"].iloc[0], "vec_id": ids[best], "score": s[r, best]}))
        return pd.concat(out, ignore_index=True) if out else none

    keys = ["block", "shard", "width"]
    best = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(tile, "query_id long, shard long, vec_id long, score long")
    while True:
        last = n_shards <= fan_in
        best = best.withColumn("shard", F.floor(F.col("shard") / fan_in))
        w = W.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if last:
            return best.select("query_id", "rank", "vec_id", "score")
        n_shards = -(-n_shards // fan_in)
        best = best.drop("rank")


__all__ = ["integer_components", "top_k"]
