"""First-wins near-duplicate removal as a distributed job.

Going through rows in order and dropping each that collides with an earlier row kept is the lexicographically first maximal
independent set. Ranges of the order do so side by side: each goes through its rows and leaves open what hangs on an earlier range. The first
range leaves nothing open, so that the rounds are at most as many as the ranges, and a chain of collisions costs no round a link. Buckets stand
for cliques, so a hot bucket costs its rows, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..sources import band_index
from ..sources.storage import delete, written
from . import neighbours, similarity


RANGE_ROWS = 500_000  # of (row, bucket) pairs that one task goes through
OPEN, KEPT, FREE = 0, 1, 2  # of a bucket: an earlier row of it is open, or kept; or neither


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows (ord) of a range that are kept for sure, from its pairs (ord, bucket, least) sorted by ord; ``least`` is the bucket's first open row."""
    state: dict[str, int] = {}
    at, buckets = None, []

    def decide() -> bool:
        states = [state[b] for b in buckets]
        kept = all(x == FREE for x in states)
        for b, x in zip(buckets, states, strict=True):
            if kept:
                state[b] = KEPT
            elif x == FREE and KEPT not in states:  # the row is open, and so are later ones of its buckets
                state[b] = OPEN
        return kept

    for pdf in frames:
        kept = []
        for ord_, bucket, least in zip(pdf["ord"].tolist(), pdf["bucket"].tolist(), pdf["least"].tolist(), strict=True):
            if ord_ != at:
                if buckets and decide():
                    kept.append(at)
                at, buckets = ord_, []
            if bucket not in state:
                state[bucket] = FREE if least == ord_ else OPEN
            buckets.append(bucket)
        yield pd.DataFrame({"ord": pd.Series(kept, dtype="int64")})
    if buckets and decide():
        yield pd.DataFrame({"ord": pd.Series([at], dtype="int64")})


def first_wins(rows: DataFrame, buckets: DataFrame, kept_before: DataFrame | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``ord`` (long) of the rows that stay. ``rows`` has ord (unique); ``buckets`` has ord, bucket; rows in one bucket collide.

    ``kept_before``: ords in ``buckets`` that are kept from the start. Rows without a bucket stay. Each round decides at least the first range of the rows still open
    (``range_rows`` pairs or so), so the rounds end.
    """
    b = buckets.select(F.col("ord").cast("long").alias("ord"), F.md5(F.col("bucket").cast("string")).alias("bucket"))
    shared = b.groupBy("bucket").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("bucket")
    b = written(b.join(shared, "bucket", "left_semi").select("ord", "bucket").distinct(), "buckets")  # a bucket of one row decides nothing
    kept = [written(rows.select(F.col("ord").cast("long").alias("ord")).join(b.select("ord").distinct(), "ord", "left_anti"), "kept")]
    new = None if kept_before is None else written(kept_before.select("ord").join(b.select("ord").distinct(), "ord", "left_semi"), "kept")
    while left := b.count():
        n = -(-left // range_rows)
        last = new is None and n == 1  # one range leaves nothing open
        if new is None:
            least = b.groupBy("bucket").agg(F.min("ord").alias("least"))
            ranges = b.join(least, "bucket").select("ord", "bucket", "least").repartitionByRange(n, "ord").sortWithinPartitions("ord")
            new = written(ranges.mapInPandas(_in_order, "ord long"), "kept")
            kept.append(new)
        if last:
            break
        hit = b.join(new, "ord", "left_semi").select("bucket").distinct()
        gone = b.join(hit, "bucket", "left_semi").select("ord").distinct()
        rest = written(b.join(gone, "ord", "left_anti"), "buckets")
        delete(b)
        b, new = rest, None
    delete(b)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    out = written(out, "stays")
    delete(*kept)
    return out


def _one_width(vectors: DataFrame) -> None:
    widths = [r[0] for r in vectors.select(F.size("vector").alias("n")).distinct().orderBy("n").limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different dimensions: {widths[0]} and {widths[1]}")


def deduplicate(
    examples: DataFrame,
    text: str = "text",
    vector: str | None = "vector",
    order: str = "ord",
    stored_vectors: DataFrame | None = None,
    metric: str = "proxy_l2sq",
    settings: Settings = DEFAULTS,
    stored_bands: DataFrame | None = None,
    stored_index: neighbours.VectorIndex | None = None,
) -> DataFrame:
    """``examples`` (order long, text, vector) with ``reason``: null (stays), `minhash` or `cosine`.

    Layer 1: a row goes if it shares a band of its MinHash signature with an earlier row that stays, or with a stored one (``stored_bands``: slot, bucket). Layer 2: if its vector is as
    similar as ``settings.similarity_reject`` to such a row's, or to a stored one. Layer 1 has precedence in the reason. Copies of a text share
    one signature; null texts are empty; rows with equal ``order`` are one row. Vectors of different widths, stored ones included, raise ``ValueError``; rows without one
    are in layer 1 only. Equal vectors are compared once. ``stored_index``, an index of the stored vectors by the same metric, takes the place of ``stored_vectors``: only cells that
    may hold a vector so similar are read, with the same result.
    """
    rows = examples.dropDuplicates([order]).withColumn("ord", F.col(order).cast("long"))
    minhash = written(band_index.text_buckets(rows.withColumn("_text", F.col(text)), "ord", "_text", settings), "layer1")
    known = None if stored_bands is None else written(band_index.colliding(minhash, stored_bands), "known")
    edges = None
    rejected = None
    if vector is not None:
        vectors = rows.where(F.col(vector).isNotNull()).select(F.col("ord").alias("id"), F.col(vector).alias("vector"))
        _one_width(vectors if stored_vectors is None else vectors.select(F.col("vector").cast("array<double>")).unionByName(stored_vectors.select(F.col("vector").cast("array<double>"))))
        if stored_vectors is not None:
            near = similarity.nearest_similarity(vectors.withColumn("id", F.concat(F.lit("new:"), F.col("id").cast("string"))), stored_vectors.select(F.concat(F.lit("old:"), F.col("id").cast("string")).alias("id"), "vector"), metric)
            rejected = written(near.where(F.col("similarity") >= settings.similarity_reject).select(F.substring("id", 5, 40).cast("long").alias("ord")), "rejected")
        elif stored_index is not None:
            if stored_index.metric != metric:
                raise ValueError(f"the index is by {stored_index.metric}, not {metric}")
            new = vectors.select(F.concat(F.lit("new:"), F.col("id").cast("string")).alias("id"), "vector")
            near = neighbours.nearest(new, stored_index, at_least=settings.similarity_reject)
            rejected = written(near.where(F.col("similarity") >= settings.similarity_reject).select(F.substring("id", 5, 40).cast("long").alias("ord")), "rejected")
        # Copies of a vector stand by their first row; with a link between two vectors, all copies of both collide.
        same = vectors.groupBy(F.col("vector").cast("array<double>").alias("vector")).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        same = written(same, "vectors")
        firsts = same.select(F.col("first").alias("id"), "vector")
        near = similarity.similar_vectors(firsts, firsts, metric, settings.similarity_reject, half=True)
        edges = written(near.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), "layer2")
        alike = same.where("copies > 1") if metric != "cosine" else same.where("copies > 1").where(F.exists("vector", lambda x: x != 0))
        copies = written(vectors.withColumn("vector", F.col("vector").cast("array<double>")).join(same, "vector").select(F.col("id").alias("ord"), "first"), "copies")
        edges = edges.select(F.explode(F.array("a", "b")).alias("first"), F.concat_ws("-", F.lit("e"), F.col("a").cast("string"), F.col("b").cast("string")).alias("bucket"))
        edges = edges.unionByName(alike.select("first", F.concat_ws("-", F.lit("v"), F.col("first").cast("string")).alias("bucket")))
        edges = copies.join(edges, "first").select("ord", "bucket")
    open_, buckets = rows.select("ord"), minhash
    if known is not None:
        open_, buckets = open_.join(known, "ord", "left_anti"), buckets.join(known, "ord", "left_anti")
        edges = None if edges is None else edges.join(known, "ord", "left_anti")
    if rejected is not None:
        open_, buckets = open_.join(rejected, "ord", "left_anti"), buckets.join(rejected, "ord", "left_anti")
    if edges is not None:
        buckets = buckets.unionByName(edges if rejected is None else edges.join(rejected, "ord", "left_anti"))
    stays = written(first_wins(open_, buckets).select("ord", F.lit(True).alias("stays")), "stays")
    # Why a row goes: an earlier row that stays in one of its layer-1 buckets, or else layer 2.
    first = minhash.join(stays, "ord").groupBy("bucket").agg(F.min("ord").alias("first"))
    lsh = minhash.join(first, "bucket").where("first < ord").select("ord")
    lsh = (lsh if known is None else lsh.unionByName(known)).select("ord", F.lit(True).alias("lsh")).distinct()
    out = rows.join(stays, "ord", "left").join(lsh, "ord", "left")
    reason = F.when(F.col("stays").isNull(), F.when(F.col("lsh"), "minhash").otherwise("cosine"))
    return out.withColumn("reason", reason).select(*examples.columns, "reason")
