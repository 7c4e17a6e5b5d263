"""Screening, rubric scores, verdicts and the counters of the stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, RUBRIC_WEIGHTS, Settings


def screened(batched: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``batched`` (keys, pos) once, with prefilter_score: 1.0 if its verdict passes, else 0.0."""
    v = verdicts.withColumnRenamed("id", "pos")
    return batched.join(v, [*keys, "pos"], "left").withColumn("prefilter_score", F.when(F.coalesce("passed", F.lit(False)), 1.0).otherwise(0.0)).drop("passed")


def passed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("prefilter_score") >= 1.0)


def composite_hundredths(rubric: Column | str = "rubric") -> Column:
    """The weighted score in hundredths: whole numbers, so thresholds are exact. A missing dimension counts 0."""
    r = F.col(rubric) if isinstance(rubric, str) else rubric
    return reduce(lambda a, b: a + b, [F.coalesce(r[d], F.lit(0)) * w for d, w in RUBRIC_WEIGHTS.items()])


def composite_score(rubric: Column | str = "rubric") -> Column:
    return composite_hundredths(rubric) / F.lit(100.0)


def verdict(hundredths: Column, settings: Settings = DEFAULTS) -> Column:
    """accept, revise or reject. What lies between the revise range and the accept threshold follows ``gap_policy``."""
    return (
        F.when(hundredths >= settings.accept, "accept")
        .when(hundredths.between(settings.revise_low, settings.revise_high), "revise")
        .when(hundredths > settings.revise_high, settings.gap_policy)
        .otherwise("reject")
    )


def judged(rows: DataFrame, rubric: str = "rubric", settings: Settings = DEFAULTS) -> DataFrame:
    """Adds composite_score and verdict; without a rubric 0.0 and reject."""
    empty = F.coalesce(F.size(rubric), F.lit(0)) <= 0
    h = composite_hundredths(rubric)
    rows = rows.withColumn("composite_score", F.when(empty, 0.0).otherwise(h / F.lit(100.0)))
    return rows.withColumn("verdict", F.when(empty, "reject").otherwise(verdict(h, settings)))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("verdict = 'accept'")


def funnel(rows: DataFrame) -> DataFrame:
    """stage, outcome, n in one pass over rows with prefilter_score, verdict and, where deduplicated, reason."""
    reason = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    told = lambda stage, outcome: F.struct(F.lit(stage).alias("stage"), outcome.alias("outcome"))
    outcome = (
        F.when(F.col("prefilter_score") < 1.0, told("screen", F.lit("fail")))
        .when(F.col("verdict") != "accept", told("judge", F.col("verdict")))
        .when(reason.isNotNull(), told("dedup", reason))
        .otherwise(told("done", F.lit("accepted")))
    )
    return rows.groupBy(outcome.alias("o")).agg(F.count("*").alias("n")).select("o.stage", "o.outcome", "n")


VERDICTS = ("accept", "revise", "reject")
REASONS = ("minhash", "cosine")


def observe_verdicts(rows: DataFrame, seen: Observation) -> DataFrame:
    """``rows`` (prefilter_score, verdict), counted by outcome while they are written: no pass of their own."""
    ok = F.coalesce(F.col("prefilter_score") >= 1.0, F.lit(False))
    said = {v: ok & F.col("verdict").eqNullSafe(v) for v in VERDICTS}
    return rows.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("fail"), *[F.count_if(is_it).alias(v) for v, is_it in said.items()],
    )


def observe_reasons(rows: DataFrame, seen: Observation) -> DataFrame:
    """``rows`` (reason, null if the row stays), counted by reason while they are written."""
    return rows.observe(seen, F.count_if(F.col("reason").isNull()).alias("accepted"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def observed_funnel(spark: SparkSession, verdicts: Observation, reasons: Observation) -> DataFrame:
    """What ``funnel`` says, from what was observed: stage, outcome, n, without outcomes that no row had; a verdict that is none of the three is `other`."""
    v, r = verdicts.get, reasons.get
    told = [("screen", "fail", v.get("fail", 0)), *[("judge", x, v.get(x, 0)) for x in VERDICTS if x != "accept"]]
    told.append(("judge", "other", v.get("rows", 0) - v.get("fail", 0) - sum(v.get(x, 0) for x in VERDICTS)))
    told += [*[("dedup", x, r.get(x, 0)) for x in REASONS], ("done", "accepted", r.get("accepted", 0))]
    return spark.createDataFrame([x for x in told if x[2]], "stage string, outcome string, n bigint")
