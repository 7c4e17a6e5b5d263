"""Filter audit, toxicity and collocations against brute force, held-out labels and the odd cases that their docstrings define."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemill.llm import filter_audit, phrases, toxicity

DOC = "doc_id long, text string, lang string, mask string, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    out = []
    for i in range(60):
        n = draw.choice([3, 40, 120, 130])
        text = " ".join(draw.choice(words) if draw.random() < 0.5 else f"w{draw.randrange(10**6)}" for _ in range(n))
        text = text.upper() if draw.random() < 0.2 else text
        text += draw.choice(["", "", " | x", ".\nNext, one"])
        out.append((i * 3, text, draw.choice(["en", "de", None])))
    out += [(500 + i, out[i % 5][1], "en") for i in range(12)]  # copies
    out += [(600, None, "en"), (601, "", "de"), (602, " \n ", ""), (603, out[0][1][:40], "fr"), (604, "x " * 30_000, "en"), (605, "é" * 200 + "\U0001f600", "fr")]
    out += [(500, out[0][1], "en"), (None, out[0][1], "en"), (None, None, None), (0, out[0][1], out[0][2])]  # repeated ids, rows without one
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "m", 1) for r in rows], DOC).repartition(5)


LABELS = [(i, i % 2, int(i % 9 == 0)) for i in range(0, 180, 3)] + [(500, 1, None), (500, 0, 1), (None, 1, 1), (3, None, None)]


def _mask(doc_id, text, rows):
    text = text or ""
    words = WORD.findall(text)
    m = 1 if len(words) < 100 else 0
    m |= 2 if 100 * len(set(words)) < 80 * len(words) else 0
    m |= 4 if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else 0
    m |= 8 if re.search(r"[#$%&*|]", text) else 0
    return m | (16 if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows) else 0)


def test_filter_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, q, t in LABELS if i is not None and (q, t)[k] == 1} for k in (0, 1))
    told = [(lang or "", _mask(i, t, rows), i in good, i in toxic) for i, t, lang in rows]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit_filters(docs, labels, part_bytes=4096).collect()}
    parts = {p for p, *_ in told}
    assert len(got) == len(parts) * 600
    shapley = Counter()
    for part in parts:
        mine = [(m, g, x) for p, m, g, x in told if p == part]
        for order in map("".join, permutations("ABCDE")):
            before = 0
            for step, letter in enumerate(order, 1):
                bit, r = 1 << "ABCDE".index(letter), got[part, order, step]
                removed = [(g, x) for m, g, x in mine if m & bit and not m & before]
                want = (sum(not m & (before | bit) for m, _, _ in mine), len(removed), sum(bool(m & bit and m & before) for m, _, _ in mine), sum(m == bit for m, _, _ in mine), sum(g for g, _ in removed), sum(x for _, x in removed))
                assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want, (part, order, step)
                shapley[part, letter] += len(removed)
                before |= bit
    assert all(r.shapley == shapley[p, o[s - 1]] for (p, o, s), r in got.items())
    assert filter_audit.audit_filters(docs.where("doc_id < 0"), labels).count() == 0


def test_radix_trie():
    draw = random.Random(2)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(12))) for _ in range(500)] + [b"long" * 5000 + x for x in (b"", b"a", b"b")]
    trie, counts = filter_audit.RadixTrie(lambda text: [text, 0]), Counter(texts)
    for t in texts:
        trie.at(t)[1] += 1
    assert {t: n for t, n in trie.terminals()} == counts


def test_splitters(spark):
    """Bounds are in order, open up a prefix that most texts share, and stay few."""
    texts = [f"{'shared ' * 30}{i:04d}".encode() for i in range(400)] + [b"same"] * 300 + [bytes([i]) for i in range(1, 30)]
    bounds = filter_audit.splitters(spark.createDataFrame([(t,) for t in texts], "text binary").repartition(3), 8)
    assert bounds == sorted(set(bounds)) and bounds[0] == b"" and 6 <= len(bounds) <= 40
    assert sum(b.startswith(b"shared shared") for b in bounds) >= 3
    assert filter_audit.splitters(spark.createDataFrame([], "text binary"), 8) == [b""]


def _grams(rows, longest):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    return f, n


def _best(rows, least, top):
    f, n = _grams(rows, 5)
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(m == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in f.items()):
            continue
        cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_collocations(spark, shard_bytes):
    draw = random.Random(9)
    rows = [(i, "".join(draw.choice(["a", "b", "é", "New York", "in New York City", "A A A"]) + draw.choice([" ", " ", " ", "\t", ", ", "\r\n"]) for _ in range(40)), draw.choice(["en", None])) for i in range(40)]
    rows += [(50, None, "en"), (51, "", None), (52, "...", "de"), (53, "only one", "fr"), (54, "a b " * 3000, "en"), (54, "a b " * 3000, "en")]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], DOC).repartition(3)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, least=8, top=60, shard_bytes=shard_bytes).collect()}
    assert got == _best(rows, 8, 60) and len(got) > 60
    assert phrases.collocations(docs.where("doc_id < 0"), least=8).count() == 0


def test_rare_pairs_are_not_shuffled(spark, monkeypatch):
    """What a tally by slots shows to be rare stays in its shard; sums over shards, and phrases frequent in none of them, are as counted."""
    draw = random.Random(4)
    texts = [" ".join([*(f"w{draw.randrange(60)}" for _ in range(300)), "x y z", "x y z"]) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "m", 1) for i, t in enumerate(texts)], DOC).repartition(5)
    sizes, extended = {}, phrases._extended

    def seen(side, mine, level, shards, least):
        found = extended(side, mine, level, shards, least)
        sizes[level] = shards, found.count()
        return found

    monkeypatch.setattr(phrases, "_extended", seen)
    f, _ = phrases.frequent_phrases(docs, least=20, longest=3, shard_bytes=2000)
    counts = Counter(" ".join(w) for t in texts for w in zip(*(t.split()[k:] for k in range(3)), strict=False))
    assert {r.phrase: r.f for r in f.where("level = 3").collect()} == {p: c for p, c in counts.items() if c >= 20} and counts["x y z"] == 60
    assert sizes[1][0] > 5 and sizes[1][1] < 0.1 * sum(counts.values())


def test_transform_beyond_packed_numbers(monkeypatch):
    """Shards of more symbols than fit a packed key are ordered alike."""
    s = np.array([0, *np.random.default_rng(3).integers(0, 6, 400), 0], dtype=np.int32)
    before = phrases.transform(s)
    monkeypatch.setattr(phrases, "PACKED", 3)
    assert (phrases.transform(s) == before).all()


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    one = spark.createDataFrame([(3 * 10**10, 10**13 + 7, 4 * 10**10 + 1, 5 * 10**10 + 3)], "a long, n long, l long, r long")
    got = one.select(phrases._cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert got == 1000 * 3 * 10**10 * (10**13 + 7) // ((4 * 10**10 + 1) * (5 * 10**10 + 3))


def _toxic(draw, n, bad):
    base = ["".join(draw.choice("bcdfglmn") + draw.choice("aeiou") for _ in range(draw.choice([1, 2, 3]))) for _ in range(n)]
    for _ in range(bad):
        base[draw.randrange(n)] = "zork" + draw.choice("bdg") + draw.choice("aeiou")
    return " ".join(base)


def test_toxicity(spark):
    draw = random.Random(6)
    rows = [(i, _toxic(draw, draw.choice([20, 90, 400]), 3 if i % 4 == 0 else 0), "en") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    long = " ".join(t for i, t, _ in rows if i % 4 and i < 300)  # of documents whose label says clean
    odd = [(1000, None, None), (1001, "", "x"), (1002, "?!", "x"), (1003, long, "x"), (1004, long + " zorkba zorkdi zorkge ok", "x"), (7, rows[7][1], "x"), (None, rows[4][1], "x")]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows + odd], DOC).repartition(4)
    weights = toxicity.train(docs, labels)
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, weights).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    told = {i: p for i, _, p in got if i is not None and i < 400}
    unseen = [i for i in range(300, 400)]
    assert sum(told[i] == (i % 4 == 0) for i in unseen) >= 97
    by = {i: p for i, _, p in got}
    assert by[1004] == 1 and by[1003] == 0 and by[1000] == by[1001] == 0 and by[None] == 1
    assert len({s for i, s, _ in got if i == 7}) == 1 and len({s for i, s, _ in got if i in (1000, 1001, 1002)}) == 1
    assert weights == toxicity.train(docs.repartition(2), labels)
    none = toxicity.score(docs, toxicity.train(docs, labels.where("doc_id < 0")))
    assert none.agg(F.max("score")).first()[0] == 0 and none.count() == len(got)
    assert toxicity.score(docs.where("doc_id < 0"), weights).count() == 0


def test_gradients():
    """The way back agrees with differences."""
    draw = np.random.default_rng(1)
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model(1).items()}
    gates = np.concatenate([draw.standard_normal((7, 6 * toxicity.HIDDEN)), np.zeros((1, 6 * toxicity.HIDDEN))])
    ids = draw.integers(0, 8, (6, 5))

    def loss(gates):
        return float((toxicity._forward(m, gates, ids) ** 2).sum())

    tape: list = []
    logit = toxicity._forward(m, gates, ids, tape)
    grad, d_gates = toxicity._backward(m, gates, ids, tape, 2 * logit)
    for name in ("u0", "u1", "a", "v", "w"):
        at = tuple(draw.integers(0, n) for n in m[name].shape)
        was = m[name][at]
        m[name][at] = was + 1e-2
        up = loss(gates)
        m[name][at] = was - 1e-2
        down = loss(gates)
        m[name][at] = was
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=0.02), name
    for at in ((0, 3), (3, 20), (6, 40)):
        moved = gates.copy()
        moved[at] += 1e-2
        up = loss(moved)
        moved[at] -= 2e-2
        assert d_gates[at] == pytest.approx((up - loss(moved)) / 2e-2, rel=0.05, abs=0.02)


def test_windows_overlap_and_cover():
    ids, begin, words = toxicity._words([b"", b"One two-three", b"w " * 200, "ÄB é".encode()])
    assert begin.tolist() == [0, 0, 3, 203, 205] and words.to_pylist() == [b"one", b"two", b"three", b"w", "Äb".encode(), "é".encode()]
    doc, first, size = toxicity._windows(begin)
    assert np.bincount(doc).tolist() == [1, 1, 6, 1] and (first[doc == 2] + size[doc == 2]).max() == 203
    assert isinstance(words, pa.Array) and len(ids) == 205
