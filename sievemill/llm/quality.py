"""Quality by perplexity under an interpolated modified Kneser-Ney model of character 4-grams, trained on trusted texts.

The model is a set of count tables by language and order. Documents are dealt into blocks; the distinct 4-grams of all blocks meet
the count tables in joins on the 4-gram, its contexts and its suffixes, and each block gets back the log-probabilities of just its own
4-grams. A document's perplexity is held against a quantile of the trusted documents' of its language, each scored by a model of the
other folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

ORDER, BITS = 4, 16  # four characters of 16 bits make one long
HELD = 1 << 20  # characters whose keys a task holds before they are counted
FOLDS = 4  # of trusted texts, by their hash: copies share a fold
BROADCAST_IDS = 4_000_000  # trusted ids that may be broadcast (32 MB of longs); more are joined by a shuffle, which texts then go through
SALTS = 64  # parts of a language where its rows meet its discounts or its limit


def gram_keys(text: str) -> np.ndarray:
    """The key of the 4-gram that ends at each character; runs of white space are one space, three come first."""
    text = " ".join(text.split())
    codes = np.frombuffer(("   " + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < ORDER:
        return np.zeros(0, dtype=np.int64)
    high = codes > 0xFFFF  # beyond 16 bits: dealt over the private-use area
    codes = np.where(high, 0xE000 + codes % 6400, codes).astype(np.uint64)
    n = len(codes) - ORDER + 1
    key = np.zeros(n, dtype=np.uint64)
    for j in range(ORDER):
        key = (key << np.uint64(BITS)) | codes[j : j + n]
    return key.view(np.int64)


def tally(rows: Iterator[tuple[str | None, str]]) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """By language, the different 4-grams of the texts, in order, and how often each comes; held are no more than these and HELD characters' keys, or one text's."""
    sums: dict = {}
    waiting: dict = {}
    held = 0

    def add() -> None:
        for lang, keys in waiting.items():
            key, c = np.unique(np.concatenate(keys), return_counts=True)
            if lang in sums:
                key, at = np.unique(np.concatenate([sums[lang][0], key]), return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([sums[lang][1], c])).astype(np.int64)
            sums[lang] = key, c.astype(np.int64)
        waiting.clear()

    for lang, text in rows:
        keys = gram_keys(text)
        waiting.setdefault(lang, []).append(keys)
        held += len(keys)
        if held >= HELD:
            add()
            held = 0
    add()
    return sums


def _counts(texts: DataFrame) -> DataFrame:
    """lang, key, c: how often each 4-gram comes in all texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, (key, c) in tally((lang, text.as_py() or "") for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True)).items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(c)], names=["lang", "key", "c"])

    return texts.mapInArrow(run, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def _with_language(rows: DataFrame, per_lang: DataFrame, dealt_by: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of their language in ``per_lang``, which is repeated for each part that a language is dealt into, so that no task holds it all."""
    many = per_lang.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salt = F.coalesce(F.pmod(F.xxhash64(dealt_by), F.lit(SALTS)), F.lit(0).cast("long"))  # never null, so that the join adds no filter on it
    return rows.withColumn("_salt", salt).join(many, ["lang", "_salt"], how).drop("_salt")


def _suffix(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1))


def train(texts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """The model of ``texts`` (lang, text): for each order its discounted n-grams (lang, key, a) and back-off weights (lang, ctx, b).

    The highest order takes counts, each lower one the number of different characters seen before the n-gram.
    """
    return _model(stored(_counts(texts), "counts4"))


def train_folds(texts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """The models of ``texts`` (lang, fold, text), in one: lang `:x` is x's of all texts, `f:x` its model of all but fold f."""
    counts = _counts(texts.select(F.concat_ws(":", "fold", "lang").alias("lang"), "text"))
    own, lang = F.substring_index("lang", ":", 1), F.expr("substring(lang, instr(lang, ':'))")
    to = F.filter(F.array(F.lit(""), *[F.lit(str(f)) for f in range(FOLDS)]), lambda f: f != own)
    dealt = counts.select(F.explode(to).alias("to"), lang.alias("of"), "key", "c")
    return _model(stored(dealt.groupBy(F.concat("to", "of").alias("lang"), "key").agg(F.sum("c").alias("c")), "counts4"))


def _model(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    model = {}
    for order in range(ORDER, 0, -1):
        n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        safe = lambda d, top: F.greatest(F.lit(0.05), F.least(F.coalesce(d, F.lit(0.5 * top)), F.lit(top * 0.95)))
        per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
        d = counts.groupBy("lang").agg(*n).select(
            "lang", safe(1 - 2 * F.when(F.col("n1") > 0, y) * per("n2", "n1"), 1.0).alias("d1"),
            safe(2 - 3 * F.when(F.col("n1") > 0, y) * per("n3", "n2"), 2.0).alias("d2"), safe(3 - 4 * F.when(F.col("n1") > 0, y) * per("n4", "n3"), 3.0).alias("d3"),
        )
        rows = _with_language(counts, d, "key").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("ctx", F.shiftrightunsigned("key", BITS) if order > 1 else F.lit(0).cast("long"))
        sums = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("all"), F.sum("d").alias("held"))
        grams = rows.join(sums, ["lang", "ctx"]).select("lang", "key", ((F.col("c") - F.col("d")) / F.col("all")).alias("a"))
        model[order] = stored(grams, f"grams{order}"), stored(sums.select("lang", "ctx", (F.col("held") / F.col("all")).alias("b")), f"weights{order}")
        if order > 1:
            lower = stored(counts.groupBy("lang", _suffix(order - 1).alias("key")).agg(F.count("*").alias("c")), f"counts{order - 1}")
            forget(counts)
            counts = lower
    model[0] = (counts.groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("floor")), None)
    return model


def log_probabilities(types: DataFrame, model: dict) -> DataFrame:
    """lang, key, logp of 4-grams (lang, key), of languages that the model has; the joins are on the n-grams, never on documents."""
    p = _with_language(types, model[0][0], "key").withColumn("p", F.col("floor"))
    for order in range(1, ORDER + 1):
        grams, weights = model[order]
        suffix = _suffix(order) if order < ORDER else F.col("key")
        p = p.withColumn("g", suffix).withColumn("ctx", F.shiftrightunsigned("g", BITS) if order > 1 else F.lit(0).cast("long"))
        p = p.join(grams.select("lang", F.col("key").alias("g"), "a"), ["lang", "g"], "left").join(weights, ["lang", "ctx"], "left")
        p = p.withColumn("p", F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(1.0)) * F.col("p")).select("lang", "key", "p")
    return p.select("lang", "key", F.log("p").alias("logp"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel to their block: compressed one by one."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        packed = pa.array([pack((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", "lang", "trusted", "text_key", "block")], packed], names=["doc_id", "lang", "trusted", "text_key", "block", "packed"])


def _unpacked(table: pa.Table) -> Iterator[str]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(p.as_py()).decode("utf-8", "surrogatepass") for p in table["packed"])


def perplexities(docs: DataFrame, model: dict, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text_key, lang, trusted, chars, perplexity of every row of ``docs`` (doc_id, lang, fold, text, trusted); null if there are no characters.

    ``lang`` names a document's model; a block has documents of one fold, so that it needs one model of a language, and about ``block_bytes`` of text.
    """
    text = F.coalesce("text", F.lit(""))
    total = docs.groupBy("fold").agg(F.sum(F.octet_length(text)).alias("bytes"))
    sizes = {r["fold"]: max(1, -(-r["bytes"] // block_bytes)) for r in total.collect()}  # FOLDS + 1 rows at most
    block, before = F.lit(0).cast("long"), 0
    for fold, blocks in sorted(sizes.items()):
        block = F.when(F.col("fold") == fold, before + F.pmod(F.xxhash64("doc_id", text), F.lit(blocks))).otherwise(block)
        before += blocks
    rows = docs.select("doc_id", "lang", "trusted", F.xxhash64(text).alias("text_key"), block.alias("block"), "text")
    rows = rows.mapInArrow(_packed, "doc_id long, lang string, trusted boolean, text_key long, block long, packed binary")

    def types(table: pa.Table) -> pa.Table:
        found = [(lang, key) for lang, (key, _) in tally(zip(table["lang"].to_pylist(), _unpacked(table), strict=True)).items()]
        block = table["block"][0].as_py()
        return pa.table({
            "block": pa.array([block] * sum(len(k) for _, k in found), pa.int64()),
            "lang": pa.concat_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(k)) for lang, k in found]),
            "key": pa.array(np.concatenate([k for _, k in found]), pa.int64()),
        })

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        said = known["lang"].combine_chunks().dictionary_encode()
        number, keys, logs = said.indices.to_numpy(), known["key"].to_numpy(), known["logp"].to_numpy()
        by = {}
        for k, lang in enumerate(said.dictionary.to_pylist()):
            mine = np.flatnonzero(number == k)
            order = mine[np.argsort(keys[mine], kind="stable")]
            by[lang] = keys[order], logs[order]
        out, sizes = [], []
        for lang, text in zip(table["lang"].to_pylist(), _unpacked(table), strict=True):
            k = gram_keys(text)
            sizes.append(len(k))
            if lang in by and len(k):
                all_, logp = by[lang]
                out.append(float(np.exp(-logp[np.searchsorted(all_, k)].mean())))
            else:
                out.append(None)
        return table.select(["doc_id", "text_key", "lang", "trusted"]).append_column("chars", pa.array(sizes, pa.int64())).append_column("perplexity", pa.array(out, pa.float64()))

    # The same exchange serves the distinct 4-grams and the way back to the blocks: both read all of its columns under one filter, or it would be made twice.
    held = rows.groupBy("block").applyInArrow(types, "block long, lang string, key long").repartition("lang", "key").where("lang is not null and key is not null")
    distinct = held.groupBy("lang", "key").agg(F.min("block").alias("first")).where("first >= 0").select("lang", "key")
    logs = log_probabilities(distinct, model)
    own = held.join(logs, ["lang", "key"]).select(F.col("block").alias("of"), "lang", "key", "logp")
    scored = rows.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(score, "doc_id long, text_key long, lang string, trusted boolean, chars long, perplexity double")
    return scored


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, spread: float = 2.0, block_bytes: int = 16 << 20, few: float = 2.0) -> DataFrame:
    """doc_id, text_key, lang, perplexity, limit, kept for every row of ``docs`` (doc_id, lang, text).

    Trusted are documents that ``labels`` (doc_id, quality) calls good, and never bad; all of them train the model. They are dealt into
    folds by text, and the perplexity of each is by a model without its fold, as that of an unseen text is. Kept are documents
    whose log-perplexity is at most that of the ``quantile`` of the trusted ones of their language, plus ``spread`` divided by
    the root of their length, as the mean over a short text varies, plus ``few`` divided by the number of the language's different trusted texts, as a quantile of few of them is
    too low. A null language is one of its own (`und`). A language without a trusted text that a model of other texts could score has no limit, and its documents stay; null, empty and blank texts have no perplexity and go.
    Repeated rows get equal results; an empty table gives an empty one; other columns stay out.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("trusted"))
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = rows.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    fold = F.when(F.col("trusted"), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("string")).otherwise("")
    rows = rows.withColumn("fold", fold)
    model = train_folds(rows.where("trusted").select("lang", "fold", "text"))
    named = rows.withColumn("lang", F.concat_ws(":", "fold", "lang"))
    scored = perplexities(named, model, block_bytes).withColumn("lang", F.expr("substring(lang, instr(lang, ':') + 1)"))
    scored = stored(scored, "perplexities")
    forget(*[t for order in range(1, ORDER + 1) for t in model[order]])
    held = scored.where("trusted and perplexity is not null")
    texts = held.select("lang", "text_key").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    limits = held.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit")).join(texts, "lang")
    limits = limits.select("lang", (F.col("limit") * F.exp(few / F.col("n"))).alias("limit"))
    out = _with_language(scored, limits, "text_key", "left")
    allowed = F.col("limit") * F.exp(spread / F.sqrt(F.greatest("chars", F.lit(1))))
    kept = F.coalesce(F.col("perplexity") <= allowed, F.col("limit").isNull() & (F.col("chars") > 0))
    return out.select("doc_id", "text_key", "lang", "perplexity", "limit", kept.alias("kept"))
