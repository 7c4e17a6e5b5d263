"""Language identification by bit-sliced Bloom filters of character trigrams.

One filter has, at each position, a bit mask of languages; the AND of an n-gram's positions is the set of all languages that hold it, for every
n-gram of every language. A text's popcount per language, corrected for that language's false-positive rate, decides. A rare n-gram tells little, so
the filters come in levels: the one of level i holds the n-grams that have at least RATES[i] of a language's n-grams, and level 0 all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

SLICE = 20  # bits of a position: a filter has 2**20 of them, whatever the corpus
HASHES = 3
MASK_BITS = 62  # languages in one mask; more languages take more masks
RATES = (0.0, 1e-5, 1e-4, 1e-3)  # least share of a language's trigrams, by level
_tables: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["letters"]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the trigrams of all texts in turn, where each text's start, and how many letters each text has.

    Letters are lower-cased; whatever stands between words, and a text's ends, count as one space.
    """
    joined = "\x00".join((t or "").lower().replace("\x00", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):  # at most one text, and that is empty
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    ends = np.append(np.flatnonzero(codes == 0), len(codes))[: len(texts)]
    letter = _letters()[codes]
    counts = np.diff(np.concatenate([[0], np.cumsum(letter)[ends - 1] * (ends > 0)])) if len(texts) else np.zeros(0, int)
    keep = letter | np.concatenate([letter[1:], [False]]) | np.concatenate([[False], letter[:-1]])
    # a space before and after each word; where words are one sign apart, the sign serves both
    at = np.flatnonzero(keep)
    c = np.where(letter[at], codes[at], 32).astype(np.uint64)
    both = np.flatnonzero((c[1:] == 32) & (c[:-1] == 32)) + 1
    at, c = np.delete(at, both), np.delete(c, both)
    if len(c) < 2:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), counts
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]]).astype(np.uint64)
    at = np.concatenate([[-1], at, [len(codes)]])
    x = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    real = c[1:-1] != 32  # trigrams with a letter in the middle
    middle = at[1:-1][real]
    x = x[real]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x, np.searchsorted(middle, np.concatenate([[-1], ends[:-1]])), counts


def batches_of(texts: list, most: int = 1_000_000) -> Iterator[list]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "") + 1
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # int64, [levels, positions, words]
    false_rate: np.ndarray  # [levels, languages]

    def languages_of(self, grams: np.ndarray, level: int = 0) -> np.ndarray:
        """For each n-gram the masks of all languages whose filter of that level holds it."""
        low = np.uint64((1 << SLICE) - 1)
        hits = self.masks[level, (grams & low).astype(np.int64)]
        for i in range(1, HASHES):
            hits = hits & self.masks[level, ((grams >> np.uint64(SLICE * i)) & low).astype(np.int64)]
        return hits

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the mean over the levels of the corrected share of its n-grams; and how many letters it has."""
        grams, starts, letters = trigrams(texts)
        sizes = np.diff(np.append(starts, len(grams)))
        total = np.zeros((len(texts), len(self.languages)))
        for level, wrong in enumerate(self.false_rate):
            hits = self.languages_of(grams, level)
            for k in range(len(self.languages)):
                sums = np.concatenate([[0], np.cumsum((hits[:, k // MASK_BITS] >> (k % MASK_BITS)) & 1)])
                share = (sums[starts + sizes] - sums[starts]) / np.maximum(sizes, 1)
                total[:, k] += np.clip((share - wrong[k]) / max(1 - wrong[k], 1e-9), 0, 1)
        return total / len(self.false_rate), letters

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for group in batches_of(texts):
            for r, n in zip(*self.rates(group), strict=True):
                if not n or not len(r):
                    yield "und", 0.0
                else:
                    best = int(r.argmax())
                    yield self.languages[best], float(r[best] / r.sum()) if r.sum() > 0 else 0.0


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs`` (doc_id, text, lang) whose lang and text are not null.

    Every trigram of every language is in that language's filter of level 0, and in those of the levels whose rate it reaches; what is counted doesn't depend on
    the size of a corpus. What reaches the driver is the filters: at most 2**20 positions for each level and 62 languages, and the list of languages.
    """
    rows = docs.where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            texts = np.array(batch["text"].to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for group in batches_of(list(texts[langs == lang]), 8_000_000):
                    grams, times = np.unique(trigrams(group)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"]
                    )

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r[0] for r in totals.select("lang").collect())
    words = max(1, -(-len(languages) // MASK_BITS))
    masks, false_rate = np.zeros((len(RATES), 1 << SLICE, words), dtype=np.int64), np.zeros((len(RATES), len(languages)))
    if languages:
        number = F.element_at(F.create_map(*[x for i, v in enumerate(languages) for x in (F.lit(v), F.lit(i))]), F.col("lang"))
        rates = counts.join(F.broadcast(totals), "lang").select("gram", (F.col("n") / F.col("total")).alias("rate"), number.alias("k"))  # a row per language
        levels = F.sequence(F.lit(0), sum(((F.col("rate") >= r).cast("int") for r in RATES[1:]), F.lit(0)))
        at = F.explode(F.array(*[F.shiftrightunsigned("gram", SLICE * i).bitwiseAND(F.lit((1 << SLICE) - 1)) for i in range(HASHES)]))
        placed = rates.select("gram", "k", F.explode(levels).alias("level")).select(at.alias("at"), "level", F.expr(f"k div {MASK_BITS}").alias("word"), F.expr(f"shiftleft(1L, cast(k % {MASK_BITS} as int))").alias("bit"))
        found = placed.groupBy("level", "at", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
        masks[found["level"].to_numpy(np.int64), found["at"].to_numpy(np.int64), found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        for level in range(len(RATES)):
            fill = [((masks[level, :, k // MASK_BITS] >> (k % MASK_BITS)) & 1).mean() for k in range(len(languages))]
            false_rate[level] = np.array(fill) ** HASHES
    forget(counts)
    return Model(languages, masks, false_rate)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row: whole texts, nothing but the text is read.

    `und` and score 0 where the text is null or has no letters; ties go to the language that sorts first. Repeated rows get
    repeated results; an empty table an empty one; a model of no language says `und`. Other columns stay out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 masks a level, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = list(shared.value.predict(batch["text"].to_pylist()))
            cols = [batch["doc_id"], pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
