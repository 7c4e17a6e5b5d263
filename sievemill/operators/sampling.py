"""Scenario sampling with a guaranteed minimum coverage of every taxonomy value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CoverageError(ValueError):
    """A sample is too small for the coverage asked for."""


def keyed(*parts: Column) -> Column:
    """A number below 2**60 from a text key; md5, so that any SQL engine gets the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def plan_size(target: int, min_coverage: int, largest_dimension: int, ad_hoc: bool = False) -> tuple[int, int]:
    """How many scenarios to draw for a target of accepted examples, and the coverage to ask for."""
    n = max(int(1.5 * target), target + 1)
    return n, max(1, min(min_coverage, n // max(1, largest_dimension))) if ad_hoc else min_coverage


def infeasible(taxonomy: DataFrame, n: int, min_coverage: int) -> DataFrame:
    """dimension, needed of the dimensions that ``n`` rows can't cover, in name order."""
    sizes = taxonomy.groupBy("dimension").agg((F.count("*") * min_coverage).alias("needed"))
    return sizes.where(F.col("needed") > n).orderBy("dimension")


def _feistel(x: Column, a: Column, b: Column, *key: Column) -> Column:
    """Where a keyed permutation of an ``a`` by ``b`` grid, four Feistel rounds, puts cell ``x``."""

    def turn(state: Column, j: Column) -> Column:
        left, right = state["l"], state["r"]
        even = j % 2 == 0
        left = F.when(even, left).otherwise((left + F.pmod(keyed(*key, j, right), a)) % a)
        right = F.when(even, (right + F.pmod(keyed(*key, j, state["l"]), b)) % b).otherwise(right)
        return F.struct(left.alias("l"), right.alias("r"))

    begin = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), begin, turn, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, k: Column, a: Column, b: Column, *key: Column) -> Column:
    """The place of ``x`` under a keyed permutation of 0 .. k-1: the grid holds ``k`` or a few more cells, and a walk that leaves the ``k`` goes on until it is back."""
    step = lambda at, _: F.when((at >= 0) & (at < k), at).otherwise(_feistel(F.when(at < 0, -1 - at).otherwise(at), a, b, *key))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - k + 1), -1 - x, step)


def sample_node_sets(
    taxonomy: DataFrame, domain: str, n: int, min_coverage: int = 3, seed: int = 0, strict: bool = True, use_case: str | None = None, start: int = 0
) -> DataFrame:
    """Rows ``start`` to ``n`` - 1 of a domain's scenarios: idx, node_id, domain, dimensions (map), use_case.

    A scenario depends on the seed and its number alone, so a larger ``n`` only adds some. A dimension of k values goes through all of them in every
    k scenarios, each time in another keyed order: the first ``n`` have every value ``min_coverage`` times as soon as ``n`` allows it, and
    afterwards all values evenly. With ``strict``, too small an ``n`` raises ``CoverageError``. No row is shuffled.
    """
    if n < 1 or min_coverage < 1:
        raise CoverageError("n and min_coverage must be 1 or more")
    if strict and (bad := infeasible(taxonomy, n, min_coverage).first()):
        raise CoverageError(f"dimension {bad['dimension']!r} needs {bad['needed']} rows, there are {n}")
    # A taxonomy is small by nature: one row per dimension, with its values and the grid they are permuted on.
    values = taxonomy.groupBy("dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("values"))
    values = values.withColumn("k", F.size("values").cast("long")).withColumn("a", F.ceil(F.sqrt("k")).cast("long")).withColumn("b", F.ceil(F.col("k") / F.col("a")).cast("long"))
    dims = values.agg(F.sort_array(F.collect_list(F.struct("dimension", "values", "k", "a", "b"))).alias("dims"))
    rows = taxonomy.sparkSession.range(start, max(start, n)).withColumnRenamed("id", "idx").crossJoin(F.broadcast(dims))  # one row

    def pick(d: Column) -> Column:
        at = permuted(F.col("idx") % d["k"], d["k"], d["a"], d["b"], F.lit(seed), d["dimension"], F.floor(F.col("idx") / d["k"]))
        return F.get(d["values"], at.cast("int"))

    entries = F.map_from_arrays(F.transform("dims", lambda d: d["dimension"]), F.transform("dims", pick))
    node = F.concat(F.lit(f"{domain}-"), F.lpad(F.col("idx").cast("string"), 6, "0"))
    node = F.when(F.col("idx") < 1_000_000, node).otherwise(F.concat(F.lit(f"{domain}-"), F.col("idx").cast("string")))
    return rows.select("idx", node.alias("node_id"), F.lit(domain).alias("domain"), entries.alias("dimensions"), F.lit(use_case).cast("string").alias("use_case"))
