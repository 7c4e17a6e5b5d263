"""How five text filters interact: every document's failures as a mask, counted for every order in which the filters may be applied.

Duplicates are found by radix tries. Texts are dealt by ranges of their bytes, cut at adaptive prefixes: a prefix that holds more than its
share of bytes is opened at its next byte, past what all its texts have in common. A task inserts its whole texts into one compressed
trie, whose terminals hold the smallest id; the traverse gives each different text its smallest id and what else it fails. Copies of
a text meet before the exchange, so a text comes once from each task that read it, and no text travels a second time: documents
meet labels and terminals as ids and digests.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_partitions, stored, text_or_empty

# The filters' letters, and the signs that D rejects.
FILTERS = "ABCDE"
SIGNS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that continue a code point
COMBINE_BYTES = 16 << 20  # of distinct texts that a task holds before it sends them on
ROW_BYTES = 256  # what a row weighs besides its text


def text_mask(text: bytes) -> int:
    """Which of A (bit 0) to D (bit 3) a UTF-8 text fails."""
    words = text.split()  # of bytes: at ASCII white space
    n, points = len(words), len(text.translate(None, _CONTINUED))
    mask = 1 if n < 100 else 0
    mask |= 2 if 100 * len(set(words)) < 80 * n else 0
    mask |= 4 if 100 * (len(text) - len(text.translate(None, _UPPER))) > 10 * points else 0
    return mask | (8 if len(text.translate(None, SIGNS)) < len(text) else 0)


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class RadixTrie:
    """A compressed trie over byte strings; ``at`` gives a string's terminal, made by ``new`` when the string comes first."""

    __slots__ = ("new", "root")

    def __init__(self, new):
        self.new, self.root = new, [b"", {}, None]  # an edge's bytes, children by first byte, terminal

    def at(self, text: bytes):
        node, i = self.root, 0
        while i < len(text):
            child = node[1].get(text[i])
            if child is None:
                child = node[1][text[i]] = [text[i:], {}, None]
                node, i = child, len(text)
            elif text.startswith(child[0], i):
                node, i = child, i + len(child[0])
            else:
                k = _common(child[0], text[i : i + len(child[0])])
                middle = [child[0][:k], {child[0][k]: child}, None]
                child[0] = child[0][k:]
                node[1][text[i]] = middle
                node, i = middle, i + k
        if node[2] is None:
            node[2] = self.new(text)
        return node[2]

    def terminals(self) -> Iterator:
        open_ = [self.root]
        while open_:
            node = open_.pop()
            open_.extend(node[1].values())
            if node[2] is not None:
                yield node[2]


def splitters(texts: DataFrame, parts: int, rounds: int = 8) -> list[bytes]:
    """Prefixes that cut ``texts`` (text binary) into about ``parts`` ranges of even bytes.

    Each round counts the bytes below the next byte of all open prefixes; what is still over its share is opened past its texts' common
    prefix. The driver sees a histogram of at most 257 counts for each open prefix, and few are open: each has a share of the bytes.
    A range that has one text only, or is still uneven after ``rounds``, stays whole: that is a matter of balance alone.
    """
    closed: list[tuple[bytes, int]] = []
    open_, most = [b""], None
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], nodes: tuple = tuple(sorted(open_))) -> Iterator[pa.RecordBatch]:
            seen: dict = {}
            for batch in batches:
                for t in batch["text"]:
                    t = t.as_py()
                    i = bisect_right(nodes, t) - 1
                    if i < 0 or not t.startswith(nodes[i]):
                        continue
                    k = len(nodes[i])
                    child = seen.setdefault((i, t[k] if k < len(t) else -1), [0, t[: k + 4096]])
                    child[0] += len(t) + ROW_BYTES
                    if not t.startswith(child[1]):
                        child[1] = child[1][: _common(child[1], t)]
            rows = [(nodes[i], b, w, p) for (i, b), (w, p) in seen.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "byte", "weight", "shared"), r, strict=True)) for r in rows], schema=pa.schema([("node", pa.binary()), ("byte", pa.int32()), ("weight", pa.int64()), ("shared", pa.binary())]))

        got = texts.mapInArrow(count, "node binary, byte int, weight long, shared binary").groupBy("node", "byte").agg(F.sum("weight").alias("weight"), F.min("shared").alias("low"), F.max("shared").alias("high")).collect()
        if most is None:
            most = max(1, sum(r["weight"] for r in got) // (2 * parts))
        open_ = []
        for r in got:
            low = bytes(r["low"])
            shared = low[: _common(low, bytes(r["high"]))]
            if r["weight"] > most and r["byte"] >= 0 and shared != bytes(r["node"]):
                open_.append(shared)
            else:
                closed.append((bytes(r["node"]) + (bytes([r["byte"]]) if r["byte"] >= 0 else b""), r["weight"]))
        if not open_:
            break
    closed += [(p, most) for p in open_]
    bounds, held = [b""], 0
    for prefix, weight in sorted(closed):
        if held and held + weight > 2 * most:
            bounds.append(prefix)
            held = 0
        held += weight
    return bounds


def first_ids(docs: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """digest (SHA-256), mask (filters A to D), first (smallest doc_id; null if no row has one) of each different text of ``docs`` (doc_id long, text binary)."""
    total = docs.agg(F.sum(F.length("text") + ROW_BYTES)).first()[0] or 0
    bounds = splitters(docs.select("text"), max(shuffle_partitions(docs.sparkSession), -(-total // part_bytes)))
    smaller = lambda a, b: b if a is None else a if b is None else min(a, b)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def send():
            buckets = [bisect_right(bounds, t) - 1 for t in held]
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(buckets, pa.int32()), pa.array(held.values(), pa.int64())], names=["text", "bucket", "first"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text not in held:
                    size += len(text) + ROW_BYTES
                held[text] = smaller(held.get(text), doc_id)
                if size > COMBINE_BYTES:
                    yield send()
                    held, size = {}, 0
        if held:
            yield send()

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(lambda text: [hashlib.sha256(text).digest(), text_mask(text), None])
        for batch in batches:
            for text, first in zip(batch["text"].to_pylist(), batch["first"].to_pylist(), strict=True):
                terminal = trie.at(text)
                terminal[2] = smaller(terminal[2], first)
        found = [*zip(*trie.terminals(), strict=True)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, (pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["digest", "mask", "first"])

    sent = docs.mapInArrow(combine, "text binary, bucket int, first long").repartitionById(len(bounds), "bucket")
    return sent.mapInArrow(tries, "digest binary, mask int, first long")


def document_masks(docs: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, part (``lang``), mask of every row of ``docs`` (doc_id, text, lang): the filters it fails, bit 0 for A to bit 4 for E.

    Null texts are empty ones, a null ``lang`` is the empty part. A document fails E if a smaller ``doc_id`` has the same text; rows that
    repeat an id have no smaller one in each other, and rows without an id don't fail it and make none fail. Other columns, whatever their names, stay out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_or_empty("text").cast("binary").alias("text"))
    told = first_ids(rows.select("doc_id", "text"), part_bytes)
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest")).join(told, "digest")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def count_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of ``masks`` (doc_id, part, mask). ``labels``: doc_id, quality, toxic; of several of an id, any that says 1 counts."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks.join(told, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in ("good", "toxic")])


def _bits(letters: Column) -> Column:
    out = F.lit(0)
    for i, letter in enumerate(FILTERS):
        out = out + F.when(letters.contains(letter), 1 << i).otherwise(0)
    return out


def audit_orders(masks: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from ``masks`` (part, mask, n, good, toxic; at most 32 rows a part).

    part, filter_order, step, kept (after the step), removed (by it), redundant (fail its filter, gone before), unique_fails (fail that
    filter only), good_lost and toxic_lost (of the removed), shapley (what the filter removes, summed over all orders).
    """
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    rows = masks.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    rows = rows.withColumn("own", _bits(F.col("letter"))).withColumn("before", _bits(F.expr("substring(filter_order, 1, step - 1)")))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, of="n": F.coalesce(F.sum(F.when(cond, F.col(of))), F.lit(0).cast("long"))
    out = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")


def audit_filters(docs: DataFrame, labels: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """``audit_orders`` of the documents' masks; an empty table gives no row."""
    return audit_orders(stored(count_masks(document_masks(docs, part_bytes), labels), "masks"))
