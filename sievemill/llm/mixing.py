"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

The rates nearest to 1 in relative entropy that give a source its target number of words are exp(lambda * size / mean),
at most 2. The convex dual has one unknown per source; all are found together by distributed Newton steps over a histogram of
sizes. Rates are rounded into copies by a hash of the row, and what a source still lacks or has over is settled along a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, forget, stored

TOP = 2  # copies of a document at most, and of a source's size
_LN2 = 0.6931471805599453


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], percent: int) -> DataFrame:
    """source, source_size, documents, target: ``percent`` of all sizes shared by weight, at most TOP times a source's size.

    Sources rank by code point, null last, and take the weights in turn. The table has one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    found = found.withColumn("r", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))
    found = stored(found.withColumn("weight", weight).drop("r"), "sources")
    goal = (found.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, before = None, -1
    while True:  # raise the common level until the sources that it doesn't fill take up the excess
        full = F.lit(False) if level is None else level * F.col("weight") > TOP * F.col("source_size")
        n, held, w = found.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, TOP * F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == before or not w:
            break
        level, before = (goal - held) / w, n
    shared = F.lit(0.0) if level is None else level * F.col("weight")
    return found.withColumn("target", F.least(shared, (TOP * F.col("source_size")).cast("double"))).drop("weight")


def tilts(sizes: DataFrame, sources: DataFrame, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """Adds ``tilt`` to ``sources``: the root of sum(size * min(TOP, exp(tilt * size / mean))) = target for each source.

    Newton steps, kept within a bracket that every step narrows (a bisection where a step would leave it). A source
    whose target is TOP times its size has no root and needs none: its tilt is null.
    """
    histogram = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    mean = F.col("source_size") / F.col("documents")
    open_ = (F.col("source_size") > 0) & (F.col("target") < TOP * F.col("source_size"))
    state = sources.withColumn("mean", mean).withColumn("tilt", F.when(open_, F.lit(0.0)))
    state = state.withColumn("low", F.lit(-1e9)).withColumn("high", F.lit(_LN2) * F.col("mean")).withColumn("error", F.when(open_, F.lit(1e300)).otherwise(F.lit(0.0)))
    state = stored(state, "tilts")
    for _ in range(rounds):
        s = state.where("tilt is not null").select(F.col("source").alias("of"), "tilt", "mean")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(_LN2)))
        sums = (
            histogram.join(s, histogram["source"].eqNullSafe(s["of"]))
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.when(F.col("tilt") * x < _LN2, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            )
            .withColumnRenamed("source", "of")
        )
        over = F.col("got") > F.col("target")
        new = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left").drop("of")
        new = new.withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(~over, F.col("tilt")).otherwise(F.col("low")))
        step = F.round(F.col("tilt") - F.when(F.col("slope") > 0, (F.col("got") - F.col("target")) / F.col("slope")), 12)
        inside = (step > F.col("low")) & (step < F.col("high"))
        error = F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        new = new.withColumn("error", F.when(F.col("got").isNull(), 0.0).otherwise(error))
        moved = F.when(inside, step).otherwise(F.round((F.col("low") + F.col("high")) / 2, 12))
        new = new.withColumn("tilt", F.when(F.col("error") > tolerance, moved).otherwise(F.col("tilt"))).select(state.columns)
        new = stored(new, "tilts")
        forget(state)
        state = new
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    forget(histogram)
    return state.select("source", "source_size", "target", "mean", "tilt")


def mix_documents(docs: DataFrame, weights: list[int] | None = None, percent: int = 150, bins: int = 1024) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with size, source_size, target, rate and taken (words, repeats counted).

    The columns of ``docs`` stay, whatever their names; those with one of the new names are replaced. Whole copies are taken, but for at most one
    document per source, which is taken in part so that a source meets its target. Null, empty and blank texts have size 0
    and take 0. Sources null, rare or holding most rows are treated alike: a source's rows are settled in ``bins`` parts by
    a hash order, so none is one task's. Repeated rows are mixed one by one. An empty table gives an empty result.
    """
    made = ["size", "source_size", "target", "rate", "taken"]
    docs = docs.drop(*made)
    # The columns of ``docs`` travel under numbers, so that none can clash with a working name.
    own = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, "doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = stored(rows.select("source", "size"), "sizes")
    state = tilts(sizes, source_targets(sizes, weights or [3, 1, 2], percent)).withColumnRenamed("source", "_of")
    forget(sizes)
    rows = rows.join(state, rows["source"].eqNullSafe(state["_of"])).drop("_of")
    full = F.col("tilt").isNull()
    rate = F.when(F.col("size") == 0, 0.0).when(full, float(TOP)).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(_LN2))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.least(F.floor(F.col("rate") + chance), F.lit(TOP))
    h = F.xxhash64("doc_id", F.lit("order"))
    rows = rows.withColumn("rate", rate).withColumn("_whole", copies * F.col("size")).withColumn("_h", h).withColumn("_bin", F.pmod(h, F.lit(bins)))
    rows = rows.withColumn("_room", TOP * F.col("size") - F.col("_whole"))
    sums = rows.groupBy(F.col("source").alias("_of"), F.col("_bin").alias("_at")).agg(
        F.sum("_whole").alias("_w"), F.sum("_room").alias("_r"), F.max("target").alias("_t")
    )
    all_ = W.partitionBy("_of")
    before = all_.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "_of", "_at", (F.floor(F.col("_t") + 0.5) - F.sum("_w").over(all_)).alias("_lack"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"), F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"),
    )
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_of"]) & (rows["_bin"] == sums["_at"]))
    inner = W.partitionBy("source", "_bin").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = {c: F.col(f"{c}0") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in ("_w", "_r")}
    rows = rows.withColumnRenamed("_whole", "_w").withColumnRenamed("_room", "_r")
    more = F.least(F.greatest(F.col("_lack") - ahead["_r"], F.lit(0)), F.col("_r"))
    less = F.least(F.greatest(-F.col("_lack") - ahead["_w"], F.lit(0)), F.col("_w"))
    return rows.withColumn("taken", (F.col("_w") + more - less).cast("long")).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)], *made)


def copies_of(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: a document once for each whole copy, and its first words where a copy is taken in part."""
    whole, part = F.expr("taken div size"), F.expr("taken % size")
    n = F.when(F.col("size") > 0, whole + F.when(part > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    rows = mixed.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), part.cast("int")), " ")
    rows = rows.withColumn("text", F.when((part > 0) & (F.col("_copy") == F.col("_n")), cut).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(columns)
