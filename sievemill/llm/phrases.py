"""Collocations from FM-indexes over word ids, one for each shard of a language.

A shard is what a task has read of a language, up to a bound. Its index is two Burrows-Wheeler transforms, of the words and of their
reverse, sorted to the depth that patterns reach. Phrases are enumerated level by level: each phrase that is frequent in all
shards together is extended, by turns to its right and to its left, and both of its intervals follow. What a shard finds at a level is added up over shards,
pairs of words first by slots that they are hashed to, so that a pair whose slot stays below the threshold isn't shuffled, then all exactly;
a phrase below the threshold is extended by none, as no longer phrase can come more often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, free_shuffles, stored, text_or_empty

DEPTH = 4  # of the sorted contexts: phrases of one more word have their counts, not their intervals
SHARD_BYTES = 8 << 20  # of text in a shard
RANGE = 22  # bits of the slots that one task adds up
SLOTS = 17, 27  # bits of the slots of a shard, and of all shards at most
PACKED = 21  # three numbers of so many bits make one long
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.ones(256, dtype=np.uint8)  # of a byte: 1 of a word, 0 between words, 2 ends a piece
_KIND[[0x20, 0x09]] = 0
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def tokens(text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 bytes, lower-cased, and before each the number of piece ends."""
    text = _LOWER[text]
    kind = _KIND[text]
    inside = kind == 1
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    bounds = np.concatenate((np.cumsum(inside)[starts] - 1, [int(inside.sum())]))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text[inside])])
    return words, np.cumsum(kind == 2)[starts]


def symbols(text: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers from 1 in their order of appearance, 0 between pieces and at both ends; the words of the numbers."""
    words, ends = tokens(text)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int32) + 1
    gap = np.concatenate(([False], np.diff(ends) > 0)) if len(ids) else np.zeros(0, bool)
    at = np.arange(len(ids)) + np.cumsum(gap) + 1
    out = np.zeros(len(ids) + int(gap.sum()) + 2, dtype=np.int32)
    out[at] = ids
    return out, coded.dictionary


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions ordered by (a, b, position)."""
    n = len(a)
    if n and max(n, int(a.max()) + 1, int(b.max()) + 1) < 1 << PACKED:
        key = a.astype(np.int64) << 2 * PACKED | b.astype(np.int64) << PACKED | np.arange(n)
        key.sort()
        return key & ((1 << PACKED) - 1)
    return np.lexsort((b, a))


def transform(s: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of a ring of symbols, its rotations ordered by their first ``DEPTH`` symbols."""
    rank, step = s, 1
    while True:
        order = _order(rank, np.roll(rank, -step))
        if 2 * step >= DEPTH:
            return s[order - 1]
        a, b = rank[order], np.roll(rank, -step)[order]
        new = np.concatenate(([0], np.cumsum((np.diff(a) != 0) | (np.diff(b) != 0))))
        rank = np.empty(len(s), dtype=np.int32)
        rank[order] = new
        step *= 2


def extend(bwt: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every symbol that precedes the patterns of the given intervals (disjoint, in order).

    Arrays of pattern, symbol, count, new low, and the number of smaller symbols in the pattern's interval, by which its other interval moves.
    """
    back = np.empty(len(bwt), dtype=np.int64)  # the mapping from last to first
    back[_order(bwt, np.zeros(len(bwt), dtype=np.int32))] = np.arange(len(bwt))
    of = np.repeat(np.arange(len(low)), size)
    begin = np.cumsum(size) - size
    at = np.arange(len(of)) - np.repeat(begin - low, size)
    order = _order(of, bwt[at])
    of, at = of[order], at[order]
    sym = bwt[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(of) != 0) | (np.diff(sym) != 0)))) if len(of) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.concatenate((first, [len(of)])))
    of, sym = of[first], sym[first]
    return of, sym, count, back[at[first]], first - begin[of]


_INDEX = "lang string, shard int, n_words long, words array<binary>, counts array<int>, forward binary, reverse binary"
_FOUND = "times long, p long, q long, place long"  # count and shard in one number, both intervals in another


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: words that come early are frequent and have small ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int32)


def build_indexes(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: lang, shard (its task and a number there), n_words, its words and their counts, both transforms. ``docs`` has text, lang; texts stay in the tasks that read them."""
    names = ["lang", "shard", "n_words", "words", "counts", "forward", "reverse"]

    def index(lang: str, texts: list, shard: int) -> pa.RecordBatch:
        s, words = symbols(np.frombuffer(b"\n".join(texts), dtype=np.uint8))
        two = [_packed(transform(x)) for x in (s, s[::-1])]
        counts = pa.array(np.bincount(s, minlength=len(words) + 1)[1:].astype(np.int32))
        held = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, counts)]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([shard], pa.int32()), pa.array([int((s > 0).sum())], pa.int64()), *held, *[pa.array([x], pa.binary()) for x in two]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, sizes = TaskContext.get().partitionId(), 0, {}, {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= shard_bytes or sum(sizes.values()) >= 4 * shard_bytes:
                    lang = max(sizes, key=sizes.get)
                    number += 1
                    sizes.pop(lang)
                    yield index(lang, held.pop(lang), part << 12 | number)
        for lang, texts in held.items():
            number += 1
            yield index(lang, texts, part << 12 | number)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _INDEX)


def _first_level(index: DataFrame) -> DataFrame:
    """lang, word, times, place of single words. Both intervals are the word's block of the sorted symbols, where ``low`` counts the words before it, not the ends of pieces."""
    rows = index.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    before = F.sum("w.counts").over(W.partitionBy("shard").orderBy("at")) - F.col("w.counts")
    return rows.select("lang", F.col("w.words").alias("word"), _pair(F.col("w.counts"), F.col("shard")).alias("times"), _pair(before, F.lit(0)).alias("place"))


def _pair(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _high(of: str) -> Column:
    return F.shiftright(of, 32)


def _low(of: str) -> Column:
    return F.col(of).bitwiseAND(F.lit(0xFFFFFFFF))


def _next_level(level: int, rightwards: bool):
    """Extends a shard's frequent phrases of ``level`` words by one of its frequent words, to the right or to the left.

    A phrase stands by the number of what it is less its last word, ``p``, and less its first, ``q``: both have to be frequent. Its first
    and last word are those in whose block its intervals lie.
    """

    def run(index: pa.Table, frequent: pa.Table) -> pa.Table:
        if not index.num_rows or not frequent.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        bwt = _unpacked(index["side"][0].as_py())
        begin = np.cumsum(np.bincount(bwt))  # where the block of symbol i + 1 begins
        block = lambda low: np.searchsorted(begin, low, side="right")
        number = np.full(len(begin) + 1, -1, dtype=np.int64)  # of a symbol, if it is a frequent word
        number[block(begin[0] + index["lows"].chunk(0)[0].values.to_numpy())] = index["numbers"].chunk(0)[0].values.to_numpy()
        own, p, q, times, place = (frequent[x].to_numpy() for x in ("number", "p", "q", "times", "place"))
        c, low, low_reverse = times >> 32, place >> 32, place & 0xFFFFFFFF
        if level == 1:
            low = low_reverse = low + begin[0]  # they are one block
        here = low_reverse if rightwards else low
        order = np.argsort(here, kind="stable")
        own, p, q, c, low, low_reverse, here = (x[order] for x in (own, p, q, c, low, low_reverse, here))
        of, sym, count, new, smaller = extend(bwt, here, c)
        ok = number[sym] >= 0
        of, sym, count, new, smaller = (x[ok] for x in (of, sym, count, new, smaller))
        if level == 1:
            other = number[sym]
        else:  # a phrase of this level that begins (ends) as the pattern goes on (starts) and whose last (first) word is the symbol
            shared, inner = (p, q) if rightwards else (q, p)
            dense = np.unique(np.concatenate([p, q]))
            key = lambda a, symbol: np.searchsorted(dense, a) << 32 | symbol
            known = key(shared, block(here))
            by = np.argsort(known)
            wanted = key(inner[of], sym)
            at = by[np.minimum(np.searchsorted(known, wanted, sorter=by), len(by) - 1)]
            ok = known[at] == wanted
            other = own[at][ok]
            of, count, new, smaller = (x[ok] for x in (of, count, new, smaller))
        low, low_reverse = (low[of] + smaller, new) if rightwards else (new, low_reverse[of] + smaller)
        if level + 1 >= DEPTH:  # the last step is to the left and needs the other interval no more
            low_reverse = np.zeros_like(low)
        pair = (own[of], other) if rightwards else (other, own[of])
        return pa.table([pa.array(x) for x in (count << 32 | index["shard"][0].as_py(), *pair, low << 32 | low_reverse)], names=names)

    names = ["times", "p", "q", "place"]
    return run


def _slot(p: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """A phrase's slot among 2 ** ``width``, the same in all shards."""
    x = p.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + q.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - width)).view(np.int64)


def _tally(found, width: int, least: int):
    """What ``found`` finds in a shard, added up by slots: in each range of slots those hit, as differences, and how often, up to ``least``."""

    def run(index: pa.Table, frequent: pa.Table) -> pa.Table:
        rows = found(index, frequent)
        at, c = _slot(rows["p"].to_numpy(), rows["q"].to_numpy(), width), rows["times"].to_numpy() >> 32
        order = np.argsort(at)
        at, c = at[order], c[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at, c = at[first], np.minimum(np.add.reduceat(c, first), least) if len(first) else c
        ranges, begin = np.unique(at >> RANGE, return_index=True)
        parts = list(zip(ranges.tolist(), begin, [*begin[1:], len(at)], strict=True))
        slots = [_packed(np.diff(at[a:b], prepend=r << RANGE)) for r, a, b in parts]
        return pa.table([pa.array(ranges, pa.int64()), pa.array(slots, pa.binary()), pa.array([_packed(c[a:b]) for _, a, b in parts], pa.binary())], names=["range", "slots", "counts"])

    return run


def _likely(tallies: DataFrame, width: int, least: int) -> np.ndarray:
    """A bit map, of 2 ** ``width`` bits, of the slots whose phrases come ``least`` times together: no other phrase can come as often."""

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << RANGE, dtype=np.int32)
        for batch in batches:
            for slots, counts in zip(batch["slots"], batch["counts"], strict=True):
                sums[np.cumsum(_unpacked(slots.as_py()))] += _unpacked(counts.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

    out = np.zeros((max(1, 1 << width >> RANGE), 1 << RANGE >> 3), dtype=np.uint8)
    for row in tallies.groupBy("range").applyInArrow(total, "range long, bits binary").collect():  # 2 ** SLOTS[1] bits at most
        out[row["range"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.ravel()


def _extended(side: DataFrame, mine: DataFrame, level: int, shards: int, least: int) -> DataFrame:
    """What the shards find at the next level; of pairs of words less what a tally over all shards shows to come fewer than ``least`` times: most of them, which need no shuffle then."""
    found = _next_level(level, level % 2 == 1)
    both = side.groupBy("shard").cogroup(mine.groupBy("shard"))
    if level > 1:  # few phrases go on: what a tally would leave out is less than the indexes it would shuffle again
        return both.applyInArrow(found, _FOUND)
    width = min(SLOTS[1], SLOTS[0] + max(0, shards - 1).bit_length())
    tallies = both.applyInArrow(_tally(found, width, least), "range long, slots binary, counts binary")
    likely = side.sparkSession.sparkContext.broadcast(_likely(tallies, width, least))
    del tallies
    free_shuffles(side.sparkSession)

    def run(index: pa.Table, frequent: pa.Table) -> pa.Table:
        rows = found(index, frequent)
        at = _slot(rows["p"].to_numpy(), rows["q"].to_numpy(), width)
        return rows.filter(pa.array((likely.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    return both.applyInArrow(run, _FOUND)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = DEPTH + 1, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, level, f, inner of all phrases of up to ``longest`` (at most 5) words that come ``least`` times; lang, n of all words.

    ``inner`` has the phrase less its last and less its first word. Null texts are empty, a null ``lang`` is `und`. Occurrences overlap, and
    none crosses a sign that ends a piece or a text's end.
    """
    if longest > DEPTH + 1:
        raise ValueError(f"phrases of more than {DEPTH + 1} words")
    index = stored(build_indexes(docs, shard_bytes), "indexes")
    shards = index.count()
    found, key, texts, scratch = _first_level(index.select("lang", "shard", "n_words", "words", "counts")), ["lang", "word"], [], [index]
    for level in range(1, longest + 1):
        # In a shard no two phrases of a level have one place: a phrase's number is the first of its places.
        same = W.partitionBy(*key)
        rows = found.withColumn("f", F.sum(_high("times")).over(same)).withColumn("number", F.min(_pair(_low("times"), _high("place"))).over(same))
        rows = stored(rows.where(F.col("f") >= least), f"phrases{level}")
        numbers = rows.groupBy("number").agg(*[F.first(c).alias(c) for c in (*key, "f")])
        scratch.append(rows)
        if level == 1:
            text = numbers.select("number", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f", F.lit(1).alias("level"), F.array().cast("array<string>").alias("inner"))
        else:
            head = texts[-1].select(F.col("number").alias("p"), "lang", F.col("phrase").alias("head"))
            tail = texts[-1].select(F.col("number").alias("q"), F.col("phrase").alias("tail"), "last")
            text = numbers.join(head, "p").join(tail, "q").select("number", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", F.lit(level).alias("level"), F.array("head", "tail").alias("inner"))
        texts.append(stored(text, f"texts{level}"))
        if level == longest:
            break
        mine = rows.withColumn("shard", _low("times").cast("int"))
        if level == 1:
            words = mine.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(_high("place").cast("int").alias("low"), "number"))).alias("w"))  # a shard's words
            words = stored(words.select("shard", F.col("w.low").alias("lows"), F.col("w.number").alias("numbers")), "vocabularies")
            mine = mine.withColumn("p", F.lit(0).cast("long")).withColumn("q", F.lit(0).cast("long"))
            scratch.append(words)
        key = ["p", "q"]
        free_shuffles(docs.sparkSession)  # of the level before
        side = index.select("shard", F.col("reverse" if level % 2 == 1 else "forward").alias("side")).join(words, "shard")
        mine = mine.select("shard", "number", "p", "q", "times", "place")
        found = _extended(side, mine, level, shards, least)
    f = None
    for text in texts:
        one = text.select("lang", "phrase", "level", "f", "inner")
        f = one if f is None else f.unionByName(one)
    f, n = stored(f, "frequent"), stored(index.groupBy("lang").agg(F.sum("n_words").alias("n")), "words")
    forget(*scratch, *texts)
    return f, n


def _cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in exact decimals; it fits a long, as a is at most each of l and r."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * 1000).cast("decimal(22,0)") * n.cast("decimal(16,0)")
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2 to ``longest`` words and come ``least`` times. A phrase's cut is that of the lowest score, ties to the shorter first part. A candidate whose
    words lie in a longer one that comes as often is dropped: then a phrase longer by one word does so too, and it alone is looked at.
    Repeated rows count each; an empty table gives an empty one; other columns stay out.
    """
    f, n = frequent_phrases(docs, least, longest, shard_bytes)
    longer = f.where("level > 1").withColumn("w", F.split("phrase", " "))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    inner = f.where("level > 2").select("lang", F.explode("inner").alias("phrase"), F.col("f").alias("f_longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f_longer").alias("f_longer"))
    kept = longer.join(most, ["lang", "phrase"], "left").where("f_longer is null or f_longer < f")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("level") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("level") - F.col("k")).alias("tail"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(n, "lang").withColumn("score", _cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language's phrases meet in one task only after each of many has kept its first ones.
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
