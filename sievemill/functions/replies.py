"""Parsing of model replies as vectorised column functions; Python's own JSON parser decides what is JSON."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RUBRIC_MAX, RUBRIC_MIN, RUBRIC_WEIGHTS

_FENCE = re.compile(r"```(?:json)?", re.IGNORECASE)


def envelope_content(reply: Column | str) -> Column:
    """choices[0].message.content of a chat reply, else an empty string."""
    return F.coalesce(F.get_json_object(reply, "$.choices[0].message.content"), F.lit(""))


def strip_fences(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, "(?i)```(?:json)?", ""), F.lit(" \t\n\r"))


def _clean(text: str | None) -> str:
    return _FENCE.sub("", text or "").strip()


def _loads(text: str):
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def array_items(text: str | None) -> list[dict]:
    """The objects of the JSON array in a reply: the whole text, or else what stands between the first [ and the last ]."""
    t = _clean(text)
    ok, value = _loads(t)
    if not ok:
        a, b = t.find("["), t.rfind("]")
        ok, value = _loads(t[a : b + 1]) if 0 <= a < b else (False, None)
    return [x for x in value if isinstance(x, dict)] if ok and isinstance(value, list) else []


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


_EXAMPLES = T.ArrayType(T.StructType([T.StructField("instruction", T.StringType()), T.StructField("response", T.StringType())]))
_VERDICTS = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("pass", T.BooleanType())]))


@F.pandas_udf(_EXAMPLES)
def _example_items(texts: pd.Series) -> pd.Series:
    def parse(text):
        out = []
        for item in array_items(text):
            pair = [item.get(a) or item.get(b) for a, b in (("instruction", "prompt"), ("response", "completion"))]
            out.append({"instruction": _text(pair[0]) if pair[0] else None, "response": _text(pair[1]) if pair[1] else None})
        return out

    return texts.map(parse)


def parse_examples(replies: DataFrame, text: str = "reply", keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """One row per usable item: example_id, prompt, completion, pos, and ``keep``. Items with a part missing or empty are dropped.

    example_id is the node's id with a hash of the content and its place, so a rerun gives the same.
    """
    rows = replies.select(*keep, F.posexplode(_example_items(text)).alias("pos", "item"))
    rows = rows.select(*keep, "pos", F.col("item.instruction").alias("prompt"), F.col("item.response").alias("completion")).where("prompt is not null and completion is not null")
    tail = F.substring(F.md5(F.concat_ws("\x00", "prompt", "completion", F.col("pos").cast("string"))), 1, 8)
    return rows.withColumn("example_id", F.concat_ws("-", *keep, tail))


@F.pandas_udf(_VERDICTS)
def _verdict_items(texts: pd.Series) -> pd.Series:
    def parse(text):
        out = []
        for item in array_items(text):
            flag, at = item.get("pass"), item.get("id")
            try:
                at = int(at)
            except (TypeError, ValueError, OverflowError):
                continue
            if isinstance(flag, bool) or (isinstance(flag, int) and flag in (0, 1)):
                if -(2**31) <= at < 2**31:
                    out.append({"id": at, "pass": bool(flag)})
        return out

    return texts.map(parse)


def parse_verdicts(replies: DataFrame, text: str, keys: list[str], size: str) -> DataFrame:
    """keys, id, passed: the last valid verdict of each id in [0, size) of a batch."""
    rows = replies.select(*keys, size, F.posexplode(_verdict_items(text)).alias("pos", "v")).where(f"v.id >= 0 and v.id < {size}")
    return rows.groupBy(*keys, F.col("v.id").alias("id")).agg(F.max_by("v.pass", "pos").alias("passed"))


def balanced_objects(text: str) -> list[str]:
    """The outermost balanced {...} blocks in order; a } that closes nothing is skipped."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(text[start : m.end()])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def object_blocks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced_objects(t or ""))


def rubric_of(text: str | None) -> dict[str, int]:
    """The rubric of a reply: the whole text, then its blocks from the last; the first with a known dimension counts."""
    t = _clean(text)
    for candidate in [t, *reversed(balanced_objects(t))]:
        ok, value = _loads(candidate)
        if not ok or not isinstance(value, dict):
            continue
        found = {}
        for name in RUBRIC_WEIGHTS:
            x = value.get(name)
            if isinstance(x, (int, float)) and not isinstance(x, bool):
                if isinstance(x, float) and not math.isfinite(x):
                    return {}
                found[name] = max(RUBRIC_MIN, min(RUBRIC_MAX, round(x)))
        if found:
            return found
    return {}


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def parse_rubric(texts: pd.Series) -> pd.Series:
    return texts.map(rubric_of)
