"""Exact near-duplicate vectors within labels by dual traversal of cover trees.

Vectors are scaled to length 1, so that cosine >= c is distance <= sqrt(2 - 2c). Equal vectors are one point with a
weight. Points of a label go to the nearest of a few pivots (the top level of the tree); cells whose covering balls are too far
apart are never compared. Cells are cut into blocks; each pair of blocks that is left is one task, which builds a cover tree for
each block (nested levels whose radii halve) and walks both: a pair of nodes whose balls keep all their points apart is dropped
with everything below it. Pairs of small nodes are decided by the exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

SLACK = 1e-9  # distances are bounds only; the cosine itself decides


class CoverTree:
    """Nested nets over unit vectors: level i has centres over 2**-i apart, each point in the ball of its nearest one."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.leaf = leaf
        self.root = self._node(np.arange(len(points)), 1.0)

    def _node(self, rows: np.ndarray, radius: float) -> tuple:
        """(centre, covering radius, rows, children): the centre is the first of the rows."""
        centre = self.points[rows[0]]
        reach = _distances(self.points[rows], centre[None])[:, 0]
        cover = float(reach.max())
        children = []
        if len(rows) > self.leaf and cover > 1e-7:
            radius = min(radius, 2.0 ** math.floor(math.log2(cover)))
            while True:
                parts = self._split(rows, radius)
                if len(parts) > 1 or radius < 1e-8:
                    break
                radius /= 2
            if len(parts) > 1 and len(parts) <= len(rows) // 2:
                children = [self._node(p, radius / 2) for p in parts]
        return centre, cover, rows, children

    def _split(self, rows: np.ndarray, radius: float) -> list[np.ndarray]:
        """A net of the rows: centres in turn, each taking the rows within ``radius`` that no centre has taken."""
        left, parts = rows, []
        while len(left):
            near = _distances(self.points[left], self.points[left[:1]])[:, 0] <= radius
            near[0] = True
            parts.append(left[near])
            left = left[~near]
            if len(parts) > len(rows) // 2:
                break
        return parts


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def dual_pairs(a: CoverTree, b: CoverTree, limit: float):
    """Blocks (rows of a, rows of b) that can hold pairs within ``limit``; all other pairs are too far apart."""
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        gap = float(_distances(x[0][None], y[0][None])[0, 0])
        if gap > limit + x[1] + y[1] + 1e-6:
            continue
        if not x[3] and not y[3]:
            yield x[2], y[2]
        elif y[3] and (not x[3] or y[1] > x[1]):
            stack += [(x, c) for c in y[3]]
        else:
            stack += [(c, y) for c in x[3]]


def _cosine(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (na[:, None] * nb[None, :])


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((v * v).sum(axis=1))
    return v / n[:, None], n


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block_rows: int = 2048, pivots: int = 16, leaf: int = 64) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and their cosine, in double precision, is at least ``cosine``; n_links counts them,
    component_id is the smallest vec_id reachable. Null labels and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; so do vectors of different widths, and rows with a null vec_id. Repeated rows count
    each other. An empty table gives an empty result; other columns are ignored.
    """
    limit = math.sqrt(2 - 2 * cosine) + SLACK
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label"))
    usable = F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("key", F.when(usable, F.xxhash64(F.col("label").cast("string"), F.size("v"))))
    points = rows.where("key is not null").groupBy("key", "v").agg(F.min("vec_id").alias("point"), F.count("*").alias("weight"))
    points = stored(points, "points")

    # The pivots of a group: the points with the least hash in each of `pivots` salts, a bounded sample.
    tops = points.groupBy("key", F.pmod(F.xxhash64("point", F.lit("pivot")), F.lit(pivots)).alias("salt")).agg(F.min_by("v", F.xxhash64("point")).alias("pivot"))
    tops = tops.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("salt", "pivot"))).alias("pivots"))  # `pivots` rows at most
    sizes = points.groupBy("key").agg(F.count("*").alias("rows"))
    # A group of one block is one cell about one pivot.
    n_tops = F.when(F.col("rows") > block_rows, F.size("pivots")).otherwise(1)
    tops = sizes.join(tops, "key").select("key", F.slice("pivots.pivot", F.lit(1), n_tops).alias("pivots"))

    def cells(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        u, _ = _unit(np.stack(a["v"].to_numpy()))
        top, _ = _unit(b["flat"].iloc[0].reshape(-1, u.shape[1]))
        d = _distances(u, top)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"key": a["key"], "point": a["point"], "cell": cell, "reach": d[np.arange(len(cell)), cell]})

    salts = sizes.withColumn("salts", F.ceil(F.col("rows") / block_rows).cast("int")).select("key", "salts")
    dealt = points.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("point"), F.col("salts")).cast("int"))
    used = dealt.select("key", "salt").distinct()
    used = used.join(tops, "key").select(F.col("key").alias("key2"), F.col("salt").alias("salt2"), F.flatten("pivots").alias("flat"))
    near = dealt.select("key", "salt", "point", "v").groupBy("key", "salt").cogroup(used.groupBy("key2", "salt2"))
    placed = stored(near.applyInPandas(cells, "key long, point long, cell int, reach double"), "cells")
    cell = placed.groupBy("key", "cell").agg(F.max("reach").alias("reach"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    cell = stored(cell, "cell")
    at = cell.join(tops, "key").select("key", "cell", "reach", "blocks", F.element_at("pivots", F.col("cell") + 1).alias("pivot"))
    left, right = at.select("key", F.struct("cell", "reach", "blocks", "pivot").alias("a")), at.select("key", F.struct("cell", "reach", "blocks", "pivot").alias("b"))
    norm = lambda p: F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("a.pivot", "b.pivot", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (norm(F.col("a.pivot")) * norm(F.col("b.pivot")))))
    met = left.join(right, "key").where(F.col("a.cell") <= F.col("b.cell"))  # at most `pivots`**2 / 2 rows a group
    met = met.where(F.coalesce(apart <= limit + F.col("a.reach") + F.col("b.reach") + 1e-6, F.lit(True)))
    # Blocks within cells, and the pairs of blocks that are tasks.
    tasks = met.select("key", F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("a.blocks") - 1)).alias("ba"), F.col("b.blocks").alias("nb"))
    tasks = tasks.withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("ca < cb or ba <= bb").select("key", "ca", "ba", "cb", "bb")
    task = F.xxhash64("key", "ca", "ba", "cb", "bb")
    tasks = stored(tasks.withColumn("task", task), "tasks")
    sides = tasks.select("task", "key", F.col("ca").alias("cell"), F.col("ba").alias("block"), F.lit(0).alias("side")).unionByName(
        tasks.where("ca <> cb or ba <> bb").select("task", "key", F.col("cb").alias("cell"), F.col("bb").alias("block"), F.lit(1).alias("side"))
    )
    blocks = placed.join(cell.select("key", "cell", "blocks"), ["key", "cell"]).withColumn("block", F.pmod(F.xxhash64("point", F.lit("block")), F.col("blocks")).cast("int"))
    members = blocks.join(points.select("key", "point", "v", "weight"), ["key", "point"]).select("key", "cell", "block", "point", "v", "weight")
    members = members.join(sides, ["key", "cell", "block"]).select("task", "side", "point", "v", "weight")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per point the weight of the points it links with here, and links enough to join what is joined here."""
        v, side = np.stack(pdf["v"].to_numpy()).astype(float), pdf["side"].to_numpy()
        point, weight = pdf["point"].to_numpy(), pdf["weight"].to_numpy()
        unit, norm = _unit(v)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(two)
        ta = CoverTree(unit[one], leaf)
        tb = ta if same else CoverTree(unit[two], leaf)
        two = one if same else two
        count, parent = np.zeros(len(pdf), dtype=np.int64), list(range(len(pdf)))
        joined = []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for ra, rb in dual_pairs(ta, tb, limit):
            ia, ib = one[ra], two[rb]
            near = _cosine(v[ia], v[ib], norm[ia], norm[ib]) >= cosine
            if same:
                near &= ia[:, None] != ib[None, :]
            count[ia] += near @ weight[ib]
            if not same:
                count[ib] += weight[ia] @ near
            for i, j in zip(*np.nonzero(near), strict=True):
                p, q = find(ia[i]), find(ib[j])
                if p != q:
                    parent[p] = q
                    joined.append((point[ia[i]], point[ib[j]]))
        hit = np.flatnonzero(count)
        u = np.concatenate([point[hit], [a for a, _ in joined]]).astype(np.int64)
        w = np.concatenate([point[hit], [b for _, b in joined]]).astype(np.int64)
        n = np.concatenate([count[hit], np.zeros(len(joined), dtype=np.int64)]).astype(np.int64)
        return pd.DataFrame({"u": u, "v": w, "n": n})

    found = stored(members.groupBy("task").applyInPandas(links, "u long, v long, n long"), "found")
    comps = components(found.where("u <> v").select("u", "v"))
    counts = found.where("n > 0").groupBy(F.col("u").alias("point")).agg(F.sum("n").alias("n"))
    known = points.select("key", "v", "point", "weight").join(counts, "point", "left").join(comps.withColumnRenamed("node", "point"), "point", "left")
    known = known.select("key", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "point").alias("component"))
    out = rows.join(known, ["key", "v"], "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )
