"""Fuzzy line deduplication (DataFrame functions only).

Distinct lines get MinHash signatures of their character shingles; lines that agree in a whole band of the signature share a
bucket. Pairs of a bucket are held against each other by the exact Jaccard similarity of their shingle sets, unless one component
of links has both already: first every line against two of its bucket, then against about eight, then all that are still apart. A bit
sketch of each set, which bounds the similarity from above, goes first and leaves few pairs to the exact test. Links are joined by
distributed union-find, and one line of each component stays: its first occurrence in the order of documents.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, stored

MAP_WORDS = 1 << 18  # of 64 bits each: the fixed size of a map of wanted ids
LONG = 256  # a line of as many shingles has its signature from about a quarter of them, chosen by their hash
SKETCH = 32  # words of 64 bits of a set's sketch
_draw = random.Random(20)
_constants = [_draw.getrandbits(64) - 2**63 for _ in range(256)]


def _starts(b: str, k: int) -> str:
    """Where in the UTF-16 bytes ``b`` of a line its shingles of ``k`` characters start; a shorter line is one shingle."""
    return f"sequence(1, greatest(octet_length({b}) - {2 * k - 1}, 1), 2)"


def shingle_sets(lines: DataFrame, k: int) -> DataFrame:
    """line_id, shingles: the distinct hashes, of 32 bits, of each line's shingles of ``k`` UTF-16 characters. ``lines`` is grouped by line_id already."""
    # A line's set is made where the line is: as an aggregate of exploded shingles it would sort them all. The outer function hands the line's
    # bytes to the inner one as a value; as a column they would be copied whole for each shingle.
    h = f"transform({_starts('b', k)}, i -> hash(substring(b, i, {2 * k})))"
    return lines.select("line_id", F.expr(f"array_distinct(element_at(transform(array(encode(line, 'UTF-16BE')), b -> {h}), 1))").alias("shingles"))


def signatures(lines: DataFrame, k: int, hashes: int) -> DataFrame:
    """line_id, long, s0 ... : minima of the shingles' hashes under XOR with constants. ``lines`` is grouped by line_id already.

    The minima of lines of LONG shingles or more are over those whose hash ends in two zero bits, a set with the same expected similarity.
    Lines of up to 5 / 4 times LONG have both signatures, so that any two lines whose sizes allow a link have signatures of one kind.
    """
    n = F.expr(f"octet_length(b) div 2 - {k - 1}")
    both = F.when(n < LONG, F.array(F.lit(False))).when(n < LONG * 5 // 4, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    b = lines.select("line_id", F.encode("line", "UTF-16BE").alias("b")).select("line_id", "b", F.explode(both).alias("long"))
    at = b.select("line_id", "long", "b", F.explode(F.expr(_starts("b", k))).alias("i"))  # one generated loop
    # The zero that is added isn't deterministic for Catalyst, so the filter stays above the hash and doesn't compute it again.
    h = at.select("line_id", "long", F.expr(f"xxhash64(substring(b, i, {2 * k})) + (spark_partition_id() & 0)").alias("h")).where("not long or (h & 3) = 0")
    return h.groupBy("line_id", "long").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"s{n}") for n, c in enumerate(_constants[:hashes])])


def _bit(key: str) -> tuple[Column, Column]:
    return F.expr(f"pmod(shiftright(xxhash64({key}), 6), {MAP_WORDS})"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")


def _marks(ids: DataFrame, key: str) -> DataFrame:
    """A bit map of fixed size (MAP_WORDS rows at most) of the ``ids``, to be broadcast."""
    word, bit = _bit(key)
    return F.broadcast(ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def _among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows that may be among ``ids`` (a column ``key``): the bit map sorts most others out before they are moved."""
    word, bit = _bit(key)
    rows = rows.withColumn("_word", word).join(_marks(ids, key), "_word")
    return rows.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def split_lines(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, pos, line_id, line: the lines of each text that aren't blank."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where("line rlike '[^\\\\s]'").select("row_key", "doc_id", "pos", F.xxhash64("line").alias("line_id"), "line")


def sketches(sets: DataFrame) -> DataFrame:
    """line_id, n, b0 ... : the size of a line's ``shingles`` and, in SKETCH words, the parity of how many of them hash to each bit.

    A bit that two sketches differ in stands for a shingle, at least, that one line has and the other hasn't.
    """
    h = sets.select("line_id", F.explode("shingles").alias("h"))
    h = h.select("line_id", F.expr(f"shiftright(h, 8) & {SKETCH - 1}").alias("word"), F.expr("shiftleft(1L, h & 63)").alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(f"b{w}") for w in range(SKETCH)]
    return h.groupBy("line_id").agg(F.count("*").alias("n"), *words)


def _near(percent: int) -> Column:
    """Whether the sketches of x and y leave a similarity of ``percent`` % possible."""
    apart = reduce(add, [F.bit_count(F.col(f"xb{w}").bitwiseXOR(F.col(f"yb{w}"))) for w in range(SKETCH)])
    return apart * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col("line_id").alias(x), F.col("comp").alias(f"{x}c"), F.col("n").alias(f"{x}n"), *[F.col(f"b{w}").alias(f"{x}b{w}") for w in range(SKETCH)])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y, linked of the distinct ``pairs``, by the exact similarity of the sets of both lines."""
    pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    wanted = _among(sets, "line_id", pairs.select(F.explode(F.array("x", "y")).alias("line_id"))).repartition("line_id")
    both = pairs.join(wanted.select(F.col("line_id").alias("x"), F.col("shingles").alias("one")), "x").join(wanted.select(F.col("line_id").alias("y"), F.col("shingles").alias("two")), "y")
    shared = both.select("x", "y", F.size(F.array_intersect("one", "two")).alias("shared"), (F.size("one") + F.size("two")).alias("total"))
    tested = stored(shared.select("x", "y", (F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).alias("linked")), "tested")
    forget(pairs)
    return tested


def _joined(joined: DataFrame, tested: DataFrame) -> DataFrame:
    """node, component with the links that were found since; the same if there are none."""
    links = tested.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)) if links.limit(1).count() else joined


def line_components(lines: DataFrame, k: int, percent: int, bands: int, band_rows: int) -> DataFrame:
    """node, component: components of the verified links between distinct lines (line_id, line) that share a bucket."""
    distinct = lines.groupBy("line_id").agg(F.first("line").alias("line"))
    signed = signatures(distinct, k, bands * band_rows)
    keys = [F.xxhash64(F.lit(n), "long", *[f"s{n * band_rows + r}" for r in range(band_rows)]) for n in range(bands)]
    signed = stored(signed.select("line_id", F.array(*keys).alias("keys")), "bands")
    bucketed = signed.select("line_id", F.explode("keys").alias("bucket"))
    hot = bucketed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo < hi")
    hot = stored(hot, "hot")
    members = stored(_among(bucketed, "bucket", hot.select("bucket")).join(hot, "bucket"), "members")
    forget(signed, hot)
    ids = members.select("line_id")
    texts = _among(lines.select("line_id", "line"), "line_id", ids).groupBy("line_id").agg(F.first("line").alias("line")).join(ids, "line_id", "left_semi")
    sets = stored(shingle_sets(texts, k), "sets")
    known = stored(sketches(sets), "sketches")

    # Every member of a bucket against its first and last, which settles buckets of up to three.
    own = known.withColumn("comp", F.col("line_id"))
    ends = members.select(F.col("line_id").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x <> y").distinct()
    pairs = ends.join(_side(own, "x"), "x").join(_side(own, "y"), "y").where(_near(percent)).select("x", "y")
    tested = [_links(pairs, sets, percent)]
    joined = known.sparkSession.createDataFrame([], "node long, component long")

    # Then against about eight, and at last all those against each other that no component has both of.
    for all_ in (False, True):
        joined = _joined(joined, tested[-1])
        comps = known.join(joined.select(F.col("node").alias("line_id"), "component"), "line_id", "left").withColumn("comp", F.coalesce("component", "line_id")).drop("component")
        comps = stored(comps, "comps")
        placed = members.where("size > 16" if all_ else "size > 3")
        placed = placed.select("bucket", "line_id", "size").join(comps.select("line_id", "comp"), "line_id")
        # A bucket's largest component needs no look at its own pairs.
        counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        mixed = counts.groupBy("bucket").agg(F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1")
        main = counts.join(mixed, "bucket").where("n = most").groupBy("bucket").agg(F.min("comp").alias("main"))
        rows = stored(placed.drop("comp").join(main, "bucket").join(comps, "line_id"), "mixed")
        turn = F.pmod(F.xxhash64("line_id", "bucket"), F.ceil(F.col("size") / 8)) == 0
        x = _side(rows.where("comp <> main"), "x", "bucket") if all_ else _side(rows, "x", "bucket")
        y = _side(rows if all_ else rows.where(turn | (F.col("size") <= 16)), "y", "bucket", "main")
        once = (F.col("yc") == F.col("main")) | (F.col("x") < F.col("y")) if all_ else F.col("x") != F.col("y")
        pairs = x.join(y, "bucket").where("xc <> yc").where(once).where(_near(percent))
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(reduce(DataFrame.unionByName, tested).select("x", "y"), ["x", "y"], "left_anti")
        tested.append(_links(pairs, sets, percent))
        forget(rows, comps)
    found = _joined(joined, tested[-1])
    forget(members, sets, known, *tested)
    return found


def dedup_lines(docs: DataFrame, k: int = 8, percent: int = 80, bands: int = 10, band_rows: int = 3) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its repeated lines, and n_lines, n_kept (lines that aren't blank).

    Two lines link at a Jaccard similarity of ``percent`` % or more of their shingles of ``k`` characters. Of each component
    the occurrence with the least (doc_id, position) stays, null ids first, all else goes with its line break. Blank lines stay. Null texts stay null,
    with no lines. Very long lines are lines like others. Rows with one doc_id and text are one document and get one
    result. An empty table gives an empty result. Columns named n_lines or n_kept are replaced, others stay, whatever their names.
    """
    docs = docs.drop("n_lines", "n_kept")
    lines = split_lines(docs)
    comps = line_components(lines.select("line_id", "line"), k, percent, bands, band_rows)
    where = lines.drop("line")
    where = where.join(comps, where["line_id"] == comps["node"], "left").select("row_key", "doc_id", "pos", F.coalesce("component", "line_id").alias("cluster"))
    where = stored(where, "occurrences")
    # Only clusters that occur twice lose lines; the least occurrence is an aggregate, so a hot line is never one task's.
    twice = where.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    where = where.join(twice, "cluster", "left_semi")
    first = where.groupBy("cluster").agg(F.min(F.struct("doc_id", "pos", "row_key")).alias("first"))
    gone = where.join(first, "cluster").where(~F.struct("doc_id", "pos", "row_key").eqNullSafe(F.col("first"))).select("row_key", "pos").distinct()
    gone = stored(gone.groupBy("row_key").agg(F.collect_list("pos").alias("gone")), "gone")  # at most the lines of one document

    # Rows travel as one struct, so that no name of theirs can clash. Those that the map of changed rows leaves out stay where they are.
    word, bit = _bit("row_key")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"))
    rows = rows.withColumn("_word", word).join(_marks(gone.select("row_key"), "row_key"), "_word", "left").withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
    same = rows.where("not _hit").select("row", F.lit(None).cast("array<int>").alias("gone"))
    changed = rows.where("_hit").select("row", "row_key").join(gone, "row_key", "left").select("row", "gone")
    rows = same.unionByName(changed)
    text = F.col("row.text")
    all_ = F.split(text, "\n")
    marked = F.filter(F.transform(all_, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    n = F.when(text.isNull(), 0).otherwise(F.size(F.filter(all_, lambda x: x.rlike("[^\\s]")))).cast("long")
    kept = n - F.coalesce(F.size("gone"), F.lit(0))
    columns = [F.when(F.col("gone").isNull(), text).otherwise(F.array_join(marked, "\n")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns, n.alias("n_lines"), kept.alias("n_kept"))
