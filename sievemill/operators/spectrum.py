"""Vendi scores of wide vectors by a Frequent Directions sketch, whose memory is set by a parameter and not by the width squared.

A sketch is at most ``size`` rows B for all rows A of a domain, so that AᵀA - BᵀB is positive and at most ``cut`` in any direction. Two
sketches make one: stack them and shrink again; the cuts add up. Their sum is at most n / (size + 1) for n vectors of length 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import delete, written

_SKETCH = "domain string, dim int, number long, n long, mass long, cut double, rows array<double>"
FAN_IN = 8  # sketches that one task merges


def shrink(rows: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At most ``size`` rows in place of ``rows``, and what was cut off every squared singular value."""
    if len(rows) <= size:
        return rows, 0.0
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    cut = float(s[size] ** 2) if len(s) > size else 0.0
    left = np.sqrt(np.maximum(s[:size] ** 2 - cut, 0))
    return left[:, None] * vt[:size], cut


def partial_sketches(rows: DataFrame, size: int, held: int = 16) -> DataFrame:
    """Sketches of ``rows`` (domain, vector), one or more for each task, domain and width; vectors are scaled to length 1.

    A task holds at most about ``held`` times ``size`` rows for all its domains together; beyond that its largest sketch goes out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        state: dict = {}  # domain, dim -> n, mass, cut, blocks, rows in blocks
        given = 0

        def out(key: tuple) -> pd.DataFrame:
            nonlocal given
            n, mass, cut, blocks, _ = state.pop(key)
            b, more = shrink(np.concatenate(blocks), size)
            given += 1
            return pd.DataFrame({"domain": [key[0]], "dim": [key[1]], "number": [first + given], "n": [n], "mass": [mass], "cut": [cut + more], "rows": [b.ravel()]})

        for pdf in frames:
            for key, part in pdf.groupby([pdf["domain"].fillna(""), pdf["vector"].map(len)]):
                key = key[0], int(key[1])
                for at in range(0, len(part), size):
                    x = np.stack(part["vector"].iloc[at : at + size].to_numpy()).astype(float)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    n, mass, cut, blocks, m = state.get(key, (0, 0, 0.0, [], 0))
                    n, mass, blocks, m = n + len(x), mass + int((norm > 0).sum()), [*blocks, x / np.where(norm > 0, norm, 1)], m + len(x)
                    if m >= 2 * size:
                        b, more = shrink(np.concatenate(blocks), size)
                        cut, blocks, m = cut + more, [b], len(b)
                    state[key] = n, mass, cut, blocks, m
                    while len(state) > 1 and sum(s[4] for s in state.values()) > held * size:
                        yield out(max(state, key=lambda k: state[k][4]))
        for key in list(state):
            yield out(key)

    rows = rows.select(F.col("domain").cast("string").alias("domain"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where("vector is not null and size(vector) > 0").mapInPandas(run, _SKETCH)


def sketches(rows: DataFrame, size: int = 256) -> DataFrame:
    """One sketch for each domain and width of ``rows`` (domain, vector), merged by ``FAN_IN`` at a time: domain, dim, n, mass (vectors that aren't zero), cut, rows (flat)."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["dim"].iloc[0])
        b, more = shrink(np.concatenate([x.reshape(-1, d) for x in pdf["rows"]]), size)
        one = pdf.iloc[:1][["domain", "dim", "number"]].copy()
        return one.assign(n=pdf["n"].sum(), mass=pdf["mass"].sum(), cut=pdf["cut"].sum() + more, rows=[b.ravel()])[["domain", "dim", "number", "n", "mass", "cut", "rows"]]

    parts = written(partial_sketches(rows, size), "sketches")
    place = (F.row_number().over(W.partitionBy("domain", "dim").orderBy("number")) - 1).cast("long")
    ids = parts.select("domain", "dim", "number", place.alias("place"))  # a row for each partial sketch, without its numbers
    last = ids.agg(F.max("place")).first()[0] or 0
    now = written(parts.join(ids, ["domain", "dim", "number"]).withColumn("number", F.col("place")).drop("place"), "sketches")
    delete(parts)
    while last > 0:
        last //= FAN_IN
        merged = now.withColumn("number", F.expr(f"number div {FAN_IN}")).groupBy("domain", "dim", "number").applyInPandas(merge, _SKETCH)
        after = written(merged, "sketches")
        delete(now)
        now = after
    return now.drop("number")


def _effective(w: np.ndarray) -> float:
    w = w[w > 1e-12]
    return float(np.exp(-(w * np.log(w)).sum())) if len(w) else 0.0


def score_bounds(w: np.ndarray, error: float, total: float) -> tuple[float, float]:
    """The least and the greatest score of eigenvalues that lie between ``w`` (falling) and ``w + error`` and add up to ``total``.

    Most uneven: the largest are raised first. Most even: all are raised to one level, as far as each may go.
    """
    left = max(total - w.sum(), 0.0)
    uneven = w + np.clip(left - error * np.arange(len(w)), 0.0, error)
    low, high = 0.0, float(w.max(initial=0.0)) + error
    for _ in range(60):
        level = (low + high) / 2
        low, high = (low, level) if np.clip(level, w, w + error).sum() > total else (level, high)
    even = np.clip(high, w, w + error)
    return _effective(uneven), _effective(even)


def vendi(rows: DataFrame, size: int = 256) -> DataFrame:
    """domain, n, score, low, high, error for each domain and width of ``rows`` (domain, vector).

    The score lies between ``low`` and ``high`` and is given as the root of their product. ``error`` bounds how far an eigenvalue of the similarity matrix over n may lie above the
    sketch's; it is at most 1 / (size + 1), and 0, all three scores being the exact one, where vectors are no wider than ``size`` or span no more directions.
    Fewer than two rows score 0.0; null and empty vectors stay out.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for domain, d, n, mass, cut, flat in pdf[["domain", "dim", "n", "mass", "cut", "rows"]].itertuples(index=False):
                low = high = 0.0
                if n >= 2 and mass:
                    s = np.linalg.svd(flat.reshape(-1, d), compute_uv=False)
                    w = np.zeros(min(d, n))
                    w[: min(len(s), len(w))] = s[: len(w)] ** 2 / n
                    low, high = score_bounds(w, cut / n, mass / n) if cut > 0 else (_effective(w),) * 2
                out.append((domain, n, (low * high) ** 0.5, low, high, cut / n))
            yield pd.DataFrame(out, columns=["domain", "n", "score", "low", "high", "error"])

    return sketches(rows, size).mapInPandas(score, "domain string, n long, score double, low double, high double, error double")
