"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal what they match.

Each value matched (an address, a number) is a protected entity. A term's disclosure of an entity is its pointwise
mutual information with it over the corpus, as a share of the entity's own information: 1 where the term comes with that entity
only, wherever in a text. Terms whose disclosure of an entity passes a threshold are generalised, above a higher one removed, in all texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. The look-behind and possessive forms match what the plain ones do, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def spans(text: str) -> list[list[tuple[int, int]]]:
    """The base spans of each kind in order: leftmost, non-overlapping within a kind, failing ones dropped."""
    out: list[list[tuple[int, int]]] = [list(_emails(text)) if "@" in text else [], [], [], []]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out[3].append(m.span())
    return out


def words_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Where each word of a text stands, of those that no base span overlaps."""
    taken = sorted(s for of in spans(text) for s in of)
    out: dict[str, list[tuple[int, int]]] = {}
    i, reach = 0, 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= s:
            out.setdefault(m[0].lower(), []).append((s, e))
    return out


def distinct_words(text: str) -> set[str]:
    """The keys of ``words_of``."""
    if any(spans(text)):
        return set(words_of(text))
    return {w.lower() for w in set(_WORD.findall(text))}


FOUND = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<kind:string,value:string>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
SLOTS, NO_TERM = 1 << 20, 1000  # of the map of terms that may disclose something: 2 MB, whatever their number
MARKS = 1 << 24  # bits of the map of disclosing terms: 2 MB, whatever their number


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def _base(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, bases, founds = [[], [], [], []], [], [], []
            for x in batch["text"]:
                text = x.as_py() or ""
                by_kind = spans(text)
                base = ",".join(f"{k}:{s}:{e}" for k, of in zip(KINDS, by_kind, strict=True) for s, e in of)
                for n, of in zip(counts, by_kind, strict=True):
                    n.append(len(of))
                bases.append(base)
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                values = sorted({(k, text[s:e].lower()) for k, of in zip(KINDS, by_kind, strict=True) for s, e in of})
                founds.append([{"kind": k, "value": v} for k, v in values])
            cols = [batch["doc_id"], batch["text_key"], *[pa.array(n, pa.int64()) for n in counts], pa.array(shas), pa.array(bases), pa.array(founds, _FOUND)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in FOUND.split(", ")[:8]] + ["found"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(run, FOUND)


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_term: in how many rows of ``docs`` each word occurs outside of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for x in batch["text"]:
                seen.update(distinct_words(x.as_py() or ""))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _levels(known: DataFrame) -> np.ndarray:
    """For each of SLOTS hashes, the least floor(log2(n_term)) of the terms of ``known`` with it; NO_TERM where there is none."""
    slot = F.crc32(F.encode("term", "UTF-8")).bitwiseAND(F.lit(SLOTS - 1))
    rows = known.select(slot.cast("int").alias("at"), F.floor(F.log2("n_term")).cast("int").alias("level")).groupBy("at").agg(F.min("level").alias("level")).toPandas()  # SLOTS rows at most
    levels = np.full(SLOTS, NO_TERM, dtype=np.int16)
    levels[rows["at"].to_numpy(np.int64)] = rows["level"].to_numpy(np.int16)
    return levels


def _pairs(texts: DataFrame, known: DataFrame, rows: int = 512) -> DataFrame:
    """class, term, n_pair, texts: for each distinct text (text, n, classes) its classes with those of its words that may be of ``known`` and
    have as many rows as the class allows (``most``), added up over few texts at a time."""
    shared = texts.sparkSession.sparkContext.broadcast(_levels(known))  # SLOTS * 2 bytes, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                found: dict = {}
                for x, n, classes in zip(batch["text"], batch["n"].to_pylist(), batch["classes"].to_pylist(), strict=True):
                    top = max(c["most"] for c in classes)
                    terms = [(w, 2.0 ** levels[zlib.crc32(w.encode()) & (SLOTS - 1)]) for w in distinct_words(x.as_py() or "")]
                    terms = [t for t in terms if t[1] <= top]
                    for c in classes:
                        for w, fewest in terms:
                            if fewest <= c["most"]:
                                was = found.get((c["class"], w), (0, 0))
                                found[c["class"], w] = was[0] + n, was[1] + 1
                if found:
                    keys, sums = zip(*found.items(), strict=True)
                    cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["class", "term", "n_pair", "texts"])

    found = texts.select("text", "n", "classes").mapInArrow(run, "class long, term string, n_pair long, texts long")
    return found.groupBy("class", "term").agg(F.sum("n_pair").alias("n_pair"), F.sum("texts").alias("texts"))


def disclosures(found: DataFrame, docs: DataFrame, support: int, least: float = 0.0) -> DataFrame:
    """term, disclosure: each term's highest, if ``least`` or more, over entities that ``support`` different texts or more share with it.

    Counts are of whole texts and over all rows. Entities with the same texts have the same disclosures and are one class. A term with n_term
    rows discloses an entity with n_entity of N rows by at most log(N / n_term) / log(N / n_entity): terms too common for ``least`` are not paired.
    """
    total = docs.count()
    texts = found.groupBy("text_key").agg(F.first("found").alias("found"), F.count("*").alias("n")).select("text_key", "n", F.explode("found").alias("f"))
    texts = stored(texts.select("text_key", "n", "f.kind", "f.value"), "entities")
    mark = [F.bit_xor(F.xxhash64("text_key", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    entities = texts.groupBy("kind", "value").agg(F.count("*").alias("texts"), F.sum("n").alias("n_entity"), *mark).where(F.col("texts") >= support)
    classed = texts.join(entities.select("kind", "value", "texts", "n_entity", F.xxhash64("texts", "h0", "h1").alias("class")), ["kind", "value"])
    classed = stored(classed.select("class", "n_entity", "text_key", "n").distinct(), "classes")
    forget(texts)
    bound = lambda n: F.pow(F.lit(float(max(total, 1))), 1 - least) * F.pow(n, least) * (1 + 1e-9)
    most = classed.agg(bound(F.max("n_entity"))).first()[0]
    if most is None:
        return classed.select(F.lit("").alias("term"), F.lit(0.0).alias("disclosure"))
    known = stored(term_counts(docs).where((F.col("n_term") >= support) & (F.col("n_term") <= most)), "terms")
    # A text's classes are as many as its entities at most.
    of_text = F.collect_list(F.struct("class", bound(F.col("n_entity")).alias("most"))).alias("classes")
    with_one = _keyed(docs).join(classed.groupBy("text_key").agg(F.first("n").alias("n"), of_text), "text_key").dropDuplicates(["text_key"])
    sizes = classed.select("class", "n_entity").distinct()
    pairs = _pairs(with_one, known).where(F.col("texts") >= support).join(sizes, "class")
    # A term's best class for equal n_entity is that with the most rows in common.
    pairs = pairs.groupBy("term", "n_entity").agg(F.max("n_pair").alias("n_pair"))
    own = F.log(total / F.col("n_entity"))
    mutual = F.log(F.col("n_pair") * float(total) / (F.col("n_term") * F.col("n_entity")))
    said = pairs.join(known, "term").groupBy("term").agg(F.max(F.when(own > 0, mutual / own).otherwise(0.0)).alias("disclosure"))
    return said.where(F.col("disclosure") >= least)


def occurrences(docs: DataFrame, risky: DataFrame) -> DataFrame:
    """text_key, start, end, disclosure: wherever a term of ``risky`` (term, disclosure) stands outside of base spans."""
    bit = F.crc32(F.encode("term", "UTF-8")).bitwiseAND(F.lit(MARKS - 1))
    words = risky.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(crc32(encode(term, 'UTF-8')) & 63 as int))").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # MARKS / 64 rows at most
    marks = np.zeros(MARKS // 64, dtype=np.int64)
    marks[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def marked(word: str) -> bool:
            h = zlib.crc32(word.encode()) & (MARKS - 1)
            return bool(bits[h >> 6] >> (h & 63) & 1)

        for batch in batches:
            for key, x in zip(batch["text_key"].to_pylist(), batch["text"], strict=True):
                text = x.as_py() or ""
                if some := {w for w in distinct_words(text) if marked(w)}:
                    rows = [(w, s, e) for w, at in words_of(text).items() if w in some for s, e in at]
                    terms, starts, ends = zip(*rows, strict=True)
                    cols = [pa.array([key] * len(rows), pa.int64()), pa.array(terms, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["text_key", "term", "start", "end"])

    at = _keyed(docs).mapInArrow(run, "text_key long, term string, start long, end long")
    return at.join(risky, "term").select("text_key", "start", "end", "disclosure").distinct()


def find_pii(docs: DataFrame, generalise: float = 0.5, remove: float = 0.8, support: int = 3) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end (code points) of the base kinds, then `term` (to be generalised) and `gone` (to be removed)
    by start. A term counts wherever it stands in a text, and one that discloses an entity is listed at every place outside of base
    spans, in texts without the entity as well. A term needs ``support`` different texts that share it with the entity: of an entity in fewer texts
    each word of these would come with it only. Null and empty texts have no spans. Repeated rows are found one by one, and copies of a text
    lend a term no support. An empty table gives an empty result; other columns are ignored.
    """
    base = stored(_base(docs), "found")
    some = base.where("n_email + n_ip + n_card + n_phone > 0")
    risky = stored(disclosures(some, docs, support, generalise), "risky")
    if not risky.limit(1).count():
        return base.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("base").alias("spans"))
    terms = occurrences(docs, risky).withColumn("kind", F.when(F.col("disclosure") >= remove, "gone").otherwise("term"))
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col("kind") == "gone", "start", "end", "kind"))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    added = terms.groupBy("text_key").agg(F.array_join(said, ",").alias("added"))
    whole = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added"))
    return base.join(added, "text_key", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", whole.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text`` and the ``spans`` of ``find_pii``) with clean texts: what a span covers becomes [KIND], or goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, said in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                cuts = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in (said or "").split(",") if x))
                out, at = [], 0
                for s, e, k in cuts:
                    if s >= at:
                        out += [text[at:s], "" if k == "gone" else f"[{k.upper()}]"]
                    at = max(at, e)
                texts.append(None if text is None else "".join([*out, text[at:]]))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["disclosures", "find_pii", "sanitise", "spans"]
