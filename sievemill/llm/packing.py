"""Packing tokenised documents into fixed sequences by cutting-stock column generation.

Documents are tokenised once, in the tasks. Whole sequences are cut off long documents; what is left of each has a length
below the capacity. The histogram of those lengths (a fixed number of classes, whatever the corpus) is a cutting-stock
problem: its linear program is solved by column generation, where a knapsack dynamic program prices new patterns. The
patterns are rounded down, the few pieces left over are fitted by best fit on the histogram, and the cluster assigns
pieces, ranked within their class, to the patterns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CACHED = 600_000  # entries of a worker's caches at most
_loaded: dict = {}


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, by the tokenizer's model."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that byte-level BPE writes as themselves
        rest = [b for b in range(256) if b not in kept]
        chars = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.spelling = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = self[word] = np.array([t.id for t in self.model.tokenize(word.translate(self.spelling))], dtype="<u4").tobytes()
        return ids


class _Chunks(dict):
    """What stands between white space -> its ids, put together from its words."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words = words
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9a-zªµºß-öø-ÿ²³¹¼½¾]+").findall

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.words.__getitem__, self.split(chunk)))
        if len(chunk) < 64:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = ids
        return ids


def token_bytes(path: str, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers, equal to ``Tokenizer.encode``.

    Texts of ASCII and Latin-1 are cut with the tokenizer's own split rule, and each distinct word is encoded once per
    worker by the tokenizer's model; other texts, and those that could hold special tokens, go to the tokenizer whole.
    """
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = tokenizer, tokenizer.model, re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*").fullmatch, _Chunks(_Words(tokenizer.model))
    tokenizer, _, plain, chunks = _loaded[path]
    if plain(text) and "<|" not in text:
        return b"".join(map(chunks.__getitem__, text.lower().split()))
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: whole sequences from the start of a document, then its rest."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = token_bytes(tokenizer_path, text.as_py() or "") + end
                n = len(data) // 4
                for s in range(0, n, capacity):
                    part = data[4 * s : 4 * (s + capacity)]
                    rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within ``room``: its value and the count of each size."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    use = np.flatnonzero(values > 1e-12)
    v, s = values[use], sizes[use]
    for c in range(1, room + 1):
        fits = s <= c
        gain = np.where(fits, best[c - np.minimum(s, c)] + v, -1.0)
        i = int(gain.argmax()) if len(gain) else -1
        if i >= 0 and gain[i] > best[c - 1] + 1e-15:
            best[c], last[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[use[last[c]]] += 1
            c -= int(s[last[c]])
    return float(best[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 0.0001, max_columns: int = 4000) -> list[tuple[int, np.ndarray]]:
    """Patterns (times used, pieces of each size) that cover ``demand`` exactly.

    The linear program starts from one column per size and is solved by the revised simplex method: the duals price
    columns in the knapsack until none improves. Uses are rounded down; what demand is left is packed by best fit.
    """
    sizes, demand = np.asarray(sizes, dtype=np.int64), np.asarray(demand, dtype=np.int64)
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(np.maximum(1, room // sizes)).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for step in range(max_columns):
        duals = inverse.sum(axis=0)
        value, pattern = _knapsack(duals, sizes, room)
        if value <= 1 + gap:  # the program's optimum is at least the present value divided by this
            break
        d = inverse @ pattern
        able = d > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, d, 1), np.inf)
        r = int(ratio.argmin())
        columns[:, r] = pattern
        pivot = inverse[r] / d[r]
        inverse -= np.outer(d, pivot)
        inverse[r] = pivot
        x = x - x[r] / d[r] * d + np.where(np.arange(m) == r, x[r] / d[r], 0.0)
        x = np.maximum(x, 0)
    left, out = demand.copy(), []
    for j in np.argsort(-x):
        pattern = columns[:, j].astype(np.int64)
        if (pattern > 0).any():
            times = min(int(x[j] + 1e-6), int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times > 0:
                out.append((times, pattern))
                left -= times * pattern
    by_size = np.argsort(-sizes)
    while left.any():
        space, pattern = room, np.zeros(m, dtype=np.int64)
        for i in by_size:
            if left[i] and sizes[i] <= space:
                n = min(int(left[i]), int(space // sizes[i]))
                pattern[i], space = n, space - n * int(sizes[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((times, pattern))
        left -= times * pattern
    return out


def pack(cut: DataFrame, capacity: int = 2048, unit: int = 16, ranked_rows: int = 50_000) -> DataFrame:
    """Give every piece (``length`` of 1 to ``capacity``) a sequence_id and an offset.

    Lengths are classed in steps of ``unit``, so there are capacity/unit classes. Pieces are ranked within a class over
    salted parts of about ``ranked_rows`` rows, so that a hot length isn't one task's. ``cut`` is read more than once.
    """
    spark = cut.sparkSession
    top = capacity // unit
    classed = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = dict(map(tuple, classed.groupBy("class").count().collect()))  # at most `top` rows
    classes = sorted(histogram)
    patterns = cutting_stock(np.array(classes), np.array([histogram[c] for c in classes]), top)
    runs: dict[int, list] = {c: [] for c in classes}  # ranks from, sequences, the first, pieces in each
    taken, sequence = dict.fromkeys(classes, 0), 0
    for times, pattern in patterns:
        for i in np.flatnonzero(pattern):
            c, n = classes[i], int(pattern[i])
            runs[c].append((taken[c], times, sequence, n))
            taken[c] += n * times
        sequence += times
    plan = spark.createDataFrame(
        [(c, start, start + n * times, first, n) for c, v in runs.items() for start, times, first, n in v],
        "class int, start_rank long, end_rank long, first long, each long",
    )
    salts = max(1, min(shuffle_partitions(spark) * 4, -(-sum(histogram.values()) // ranked_rows)), min(64, shuffle_partitions(spark)))
    salted = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("class", "salt").count()
    before = F.sum("count").over(W.partitionBy("class").orderBy("salt")) - F.col("count")
    counts = counts.select("class", "salt", before.alias("before"))
    ranked = salted.withColumn("n", F.row_number().over(W.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    # `counts` and `plan` have a bound: capacity/unit classes, times the salts or the patterns, as many as classes.
    ranked = ranked.join(F.broadcast(counts), ["class", "salt"]).withColumn("rank", F.col("n") + F.col("before"))
    here = (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("start_rank")) & (F.col("rank") < F.col("end_rank"))
    ranked = ranked.join(F.broadcast(plan), here).drop(plan["class"])
    ranked = ranked.withColumn("sequence_id", F.col("first") + F.expr("(rank - start_rank) div each"))
    order = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, unit: int = 16) -> DataFrame:
    """Tokenise, cut and pack all rows of ``docs`` (doc_id, text).

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are the end id alone. Very long texts give many pieces. Repeated rows are packed separately. An empty
    table gives an empty result. Other columns are ignored.
    """
    return pack(stored(pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity, unit)
