"""Sharding by histogram sort (DataFrame functions only).

Every row gets a 64-bit sort key: the high half hashes the text, so equal texts are neighbours; the low half hashes
the id, so a hot group of copies can still be cut. Splitters between shards are found by counting, exactly and over all rows, the
bytes below candidate boundaries, and refining only the bins in which a splitter lies. One exchange then moves the rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, stored, text_or_empty

FIRST_BITS, NEXT_BITS = 12, 8


def sort_key(doc_id: Column, text: Column) -> Column:
    low = F.xxhash64(doc_id, F.lit("row")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.xxhash64(text), 32).bitwiseOR(low)


def find_splitters(sized: DataFrame, parts: int, every: int, tolerance: float = 0.0005) -> list[int]:
    """``parts - 1`` ascending keys; part p holds the keys k with splitter[p-1] <= k < splitter[p].

    ``sized`` has ``k`` long and ``size`` long. Each round is one aggregation over the bins that still hold a splitter
    (at most 4096 bins, then 256 in each of at most ``parts - 1``), so what reaches the driver has a fixed bound.
    Every ``every``-th splitter (a shard's end) is refined until its bin holds at most ``tolerance`` of a shard, the
    others (within a shard, only for numbering rows) until a fifth of a part. A bin with one row can't be refined.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    if not total or parts < 2:
        return [0] * max(0, parts - 1)
    goals = {j: total * j / parts for j in range(1, parts)}
    slack = {j: total * every / parts * tolerance if j % every == 0 else total / parts / 5 for j in goals}
    found: dict[int, int] = {}
    shift = 64 - FIRST_BITS
    inside = {None: (0, list(goals))}  # bin at the last level -> bytes below it, goals in it
    while inside:
        rows = sized
        if None not in inside:
            rows = rows.where(F.shiftright("k", shift + width).isin([b for b in inside]))
        bins: dict = {}
        for b, size, n in rows.groupBy(F.shiftright("k", shift).alias("b")).agg(F.sum("size"), F.count("*")).collect():
            bins.setdefault(None if None in inside else b >> width, []).append((b, size, n))
        after: dict = {}
        for parent, (below, wanted) in inside.items():
            level = sorted(bins[parent])
            ends, s = [], below
            for _, size, _ in level:
                s += size
                ends.append(s)
            for j in wanted:
                i = min(bisect_left(ends, goals[j]), len(level) - 1)
                b, size, n = level[i]
                if size <= slack[j] or n == 1 or shift == 0:
                    start = ends[i] - size
                    found[j] = (b if goals[j] - start <= ends[i] - goals[j] else b + 1) << shift
                else:
                    after.setdefault(b, (ends[i] - size, []))[1].append(j)
        inside, width = after, min(NEXT_BITS, shift)
        shift -= width
    keys = [min(found[j], 2**63 - 1) for j in sorted(found)]
    for i in range(1, len(keys)):
        keys[i] = max(keys[i], keys[i - 1])
    return keys


def shard_documents(docs: DataFrame, shards: int = 24, segments: int = 8, tolerance: float = 0.0005) -> DataFrame:
    """Deal all rows into ``shards`` shards whose bytes (UTF-8 text plus 8) are near equal.

    Returns doc_id, text, size, text_crc32, shard, slot. Slots follow the sort key and are gapless from 0 within a
    shard; each shard is numbered in ``segments`` parts, so no task sorts a whole shard. Null text counts as empty,
    a null id is an id like others, rows repeated whole share a key and stay together; an empty table gives an empty result; other
    columns of ``docs``, whatever their names, are ignored.
    """
    text = text_or_empty("text")
    rows = docs.select(
        "doc_id",
        "text",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        sort_key(F.col("doc_id"), text).alias("k"),
    )
    sized = stored(rows.select("k", "size"), "sizes")
    splitters = find_splitters(sized, shards * segments, segments, tolerance)
    part = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in splitters]), lambda s: s <= F.col("k")))
    counts = dict(map(tuple, sized.groupBy(part.alias("part")).count().collect()))  # one row for each part
    forget(sized)
    starts, s = [], 0
    for p in range(shards * segments):
        s = 0 if p % segments == 0 else s
        starts.append(s)
        s += counts.get(p, 0)
    order = W.partitionBy("part").orderBy("k", "doc_id", "size")
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part") + 1)
    return (
        rows.withColumn("part", part)
        .withColumn("slot", first + F.row_number().over(order) - 1)
        .select("doc_id", "text", "size", "text_crc32", F.floor(F.col("part") / segments).cast("int").alias("shard"), "slot")
    )
