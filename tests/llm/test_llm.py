"""The corpus operators against brute force, and on the odd cases that each docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import common, langid, line_dedup, mixing, neardup, ngram_join, packing, pii, quality, sharding, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"
WORDS = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in "nrst"]


def _words(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    out = {}
    for i in range(12):
        t = "\n".join(_words(draw, 14) + "." for _ in range(6))
        out[10 * i] = t
        if i % 3 == 0:
            out[10 * i + 1] = t  # an exact copy
            parts = t.split(" ")
            parts[20] = "changed"
            out[10 * i + 2] = " ".join(parts)  # a near copy
    out[500], out[501], out[502], out[503], out[504] = None, "", "  \n ", "one two", "ONE two"
    out[505] = _words(draw, 3000)  # very long
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4], len(t or ""), 1, "x") for k, t in texts.items()]
    rows += [(505, texts[505], "en", "a", 1, 1, "x"), (None, "a text without an id at all here", "en", "b", 1, 1, "x")]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOC).repartition(3)


def _groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(17)] + [(200, i) for i in range(201, 230)]
    got = common.components(spark.createDataFrame(edges, "u long, v long"))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in got.collect()} == _groups([e for e in edges if e[0] != e[1]], nodes)


def _shingles(line, k=8):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def test_line_dedup(spark, docs, texts):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    seen = sorted({line for t in texts.values() for line in (t or "").split("\n") if line.strip()})
    sets = [_shingles(x) for x in seen]
    links = [(i, j) for i in range(len(seen)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])]
    group = _groups(links, range(len(seen)))
    number, taken = {x: i for i, x in enumerate(seen)}, set()
    for k in sorted(texts):
        kept = []
        for line in (texts[k] or "").split("\n"):
            g = group[number[line]] if line.strip() else None
            if g is None or g not in taken:
                kept.append(line)
            if g is not None:
                taken.add(g)
        assert got[k].text == (None if texts[k] is None else "\n".join(kept)), k
    assert got[500].n_lines == 0 and got[1].n_kept == 0 and got[1].n_lines == 6
    assert line_dedup.dedup_lines(docs.where("doc_id < 0")).count() == 0
    assert "size" in line_dedup.dedup_lines(docs).columns


def test_line_chains(spark):
    draw = random.Random(20)
    letters = "abcdefghijklmnopqrstuvwxyz "

    def edited(line, n):
        line = list(line)
        for i in draw.sample(range(len(line)), n):
            line[i] = draw.choice(letters)
        return "".join(line)

    template = "".join(draw.choice(letters) for _ in range(400))
    variants = [edited(template, 2) for _ in range(60)]
    lines = sorted({*variants, *[edited(draw.choice(variants), 4) for _ in range(40)]})  # the latter often reach the rest by one variant only
    sets = [_shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])]
    group = _groups(links, range(len(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_kept > 0")
    assert {r.doc_id for r in got.collect()} == {i for i, g in group.items() if i == g}


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_bytes():
    path, t = _tokenizer()
    odd = ["", "don't we'll I'd 12½ <|endoftext|> x", "É́ ΣΑΣ İ x y", "naïve­café a--b!!c", "日本語 text", "\x1c a\x85b", "It's O'Reilly's 3.5% 'tis 've", "x" * 500]
    for text in odd:
        assert packing.token_bytes(path, text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_packing(spark, docs, texts):
    path, t = _tokenizer()
    rows = packing.pack_documents(docs.where("doc_id is not null"), path, capacity=128).toPandas()
    for k, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = rows[rows.doc_id == k].sort_values("start")
        assert mine.length.sum() == len(ids) * (2 if k == 505 else 1)
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.cumsum() - rows.sort_values(["sequence_id", "offset"]).length == rows.sort_values(["sequence_id", "offset"]).offset).all()
    assert by.length.sum().max() <= 128 and sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique()))
    assert packing.pack_documents(docs.where("doc_id < 0"), path).count() == 0


def test_cutting_stock():
    rng = np.random.default_rng(2)
    for room in (8, 32):
        sizes = np.arange(1, room + 1)
        demand = 400 // sizes + rng.integers(0, 3, room)  # enough small pieces to fill what large ones leave
        plan = packing.cutting_stock(sizes, demand, room)
        assert (sum(n * p for n, p in plan) == demand).all() and all((p * sizes).sum() <= room for _, p in plan)
        assert sum(n for n, _ in plan) <= 1.02 * (sizes * demand).sum() / room + room
    assert packing.cutting_stock(np.array([], dtype=int), np.array([], dtype=int), 8) == []


def _vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        v = rng.normal(size=8)
        rows.append((3 * i, v.tolist(), i % 3))
        if i % 4 == 0:
            rows.append((3 * i + 1, (v + rng.normal(size=8) * 0.12).tolist(), i % 3))
    rows += [(9000 + i, rows[0][1], 0) for i in range(5)]  # copies
    rows += [(9100, None, 0), (9101, [0.0] * 8, 0), (9102, [float("nan")] * 8, 0), (9103, [1.0, None] * 4, 1), (9104, rows[0][1], None), (9105, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def test_topk(spark):
    df, rows = _vectors(spark)
    q = df.select("vec_id", topk.integer_components(F.col("embedding")).alias("q")).where("q is not null")
    got = topk.top_k(q, q.where("vec_id % 5 = 0"), k=4, query_block=7, shard_rows=16, fan_in=2).collect()
    ok = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {i: sorted((-int(ok[i] @ w), j) for j, w in ok.items() if j != i and len(w) == len(ok[i]))[:4] for i in ok if i % 5 == 0}
    assert {i: sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == i) for i in want} == {i: [(k + 1, s, j) for k, (s, j) in enumerate(w)] for i, w in want.items()}
    big = np.array([[2**40, 1]]), np.array([[2**20, 3]])
    assert topk._scores(*big)[0, 0] == 2**60 + 3
    assert topk.top_k(q.where("vec_id < 0"), q.where("vec_id < 0")).count() == 0


def test_neardup(spark):
    df, rows = _vectors(spark)
    rows = [r for r in rows if r[0] is not None]
    usable = {i: (np.array(v), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, (x, p) in usable.items() for b, (y, q) in usable.items() if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    group = _groups(links, [r[0] for r in rows])
    degree = {r[0]: sum(r[0] in e for e in links) for r in rows}
    for block in (2048, 8):
        got = {r.vec_id: r for r in neardup.near_duplicates(df.where("vec_id is not null"), block_rows=block, pivots=4, leaf=4).collect()}
        assert {i: r.component_id for i, r in got.items()} == group and {i: r.n_links for i, r in got.items()} == degree
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert neardup.near_duplicates(df).where("vec_id is null").first()["n_links"] == 0
    assert neardup.near_duplicates(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("shards", [4, 24])
def test_sharding(spark, docs, texts, shards):
    assert sharding.shard_documents(docs).count() == docs.count()
    docs = docs.dropDuplicates(["doc_id"])  # rows repeated whole stay together
    rows = sharding.shard_documents(docs, shards=shards, segments=2).toPandas()
    sizes = rows.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert (sizes - sizes.sum() / shards).abs().max() <= rows["size"].max()
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    for r in rows[rows.doc_id.notna()].itertuples():
        data = (texts[int(r.doc_id)] or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
    assert sharding.shard_documents(docs.where("doc_id < 0")).count() == 0


def test_langid(spark, docs):
    draw = random.Random(8)
    kinds = {"xa": "the and of in tion er", "xb": "der und die ung heit sch"}
    rows = [(i, " ".join(draw.choice(kinds[k].split()) + draw.choice("aeiou") for _ in range(40)), k) for i in range(60) for k in kinds]
    model = langid.train(spark.createDataFrame([r for r in rows if r[0] < 40], "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1000 * i, t) for i, (n, t, k) in enumerate(rows) if n >= 40] + [(1, None), (2, ""), (3, "12 !"), (4, "x"), (5, "日本")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(test, model).collect()}
    assert all(got[1000 * i].lang_pred == k for i, (n, _, k) in enumerate(rows) if n >= 40)
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred in kinds and all(0 <= r.score <= 1 for r in got.values())
    none = langid.train(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("doc_id < 0"), model).count() == 0
    many = langid.train(spark.createDataFrame([(i, f"q{chr(97 + i % 26)}{chr(97 + i // 26)}z " * 9, f"l{i:03d}") for i in range(70)], "doc_id long, text string, lang string"))
    assert len(many.languages) == 70 and next(many.predict(["qaaz qaaz"]))[0] == "l000"


def test_langid_equals_plain_sets(spark):
    """The filters answer as sets of trigrams by level do: all languages of every trigram, and each text's rates but for false positives."""
    draw = random.Random(18)
    kinds = {"xa": "the and of in tion er", "xb": "der und die ung heit sch", "xc": "le la les et ment que"}
    said = [(i, " ".join(draw.choice(kinds[k].split()) + draw.choice("aeiou") for _ in range(30)), k) for i in range(40) for k in kinds] + [(99, "", "xa"), (98, None, "xb")]
    model = langid.train(spark.createDataFrame(said, "doc_id long, text string, lang string"))
    counts: dict = {k: {} for k in kinds}
    for _, t, k in said:
        for g in langid.trigrams([t])[0].tolist():
            counts[k][g] = counts[k].get(g, 0) + 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    sets = [{k: {g for g, n in c.items() if n / total[k] >= rate} for k, c in counts.items()} for rate in langid.RATES]
    everything = np.array(sorted(set().union(*sets[0].values())), dtype=np.uint64)
    for level, own in enumerate(sets):
        hits = model.languages_of(everything, level)[:, 0]
        for bit, k in enumerate(model.languages):
            inside = np.array([g in own[k] for g in everything.tolist()])
            got = (hits >> bit) & 1 == 1
            assert got[inside].all() and (got & ~inside).sum() <= 2  # none left out; a false positive is rare
    texts = [t for _, t, _ in said[:60]] + ["qqq the zzz", "x", "THE AND\x00of " * 2000, None]
    rates, _ = model.rates(texts)
    for text, row in zip(texts, rates, strict=True):
        grams = langid.trigrams([text])[0].tolist()
        plain = [np.mean([sum(g in s[k] for g in grams) / max(len(grams), 1) for s in sets]) for k in model.languages]
        assert np.allclose(row, plain, atol=0.02)
    tie = langid.train(spark.createDataFrame([(1, "abc def", "y"), (2, "abc def", "x")], "doc_id long, text string, lang string"))
    assert next(tie.predict(["abc"]))[0] == "x"
    odd = spark.createDataFrame([(7, "the and of", "k"), (7, "the and of", "k"), (None, "der und die", None)], "doc_id long, text string, level string")
    assert sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(odd, model).collect()) == [(0, "xb"), (7, "xa"), (7, "xa")]


def test_langid_rare_language(spark):
    rows = spark.range(22_000).selectExpr("id as doc_id", "concat('the and of in tion er w', id % 50) as text", "'xa' as lang")
    rare = spark.createDataFrame([(50_000, "zug ulm qix", "xr")], "doc_id long, text string, lang string")
    model = langid.train(rows.unionByName(rare))
    assert model.languages == ["xa", "xr"] and next(model.predict(["qix ulm"]))[0] == "xr"


def test_quality(spark):
    draw = random.Random(9)
    good = [(i, "en", _words(draw, 60) + ".") for i in range(120)]
    bad = [(1000 + i, "en", "".join(draw.choice("#$%&*@!~^") + draw.choice("QXZJ") for _ in range(200))) for i in range(5)]
    odd = [(2000, "en", None), (2001, "en", ""), (2002, "fr", "une langue sans textes"), (2003, None, _words(draw, 30)), (0, "en", good[0][2])]
    docs = spark.createDataFrame([*good, *bad, *odd], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(1000, 0), (1001, None), (None, 1)], "doc_id long, quality int")
    got = {(r.doc_id, r.text_key): r for r in quality.classify(docs, labels, block_bytes=16_000).collect()}
    kept = {k[0]: r.kept for k, r in got.items()}
    assert not any(kept[1000 + i] for i in range(5)) and sum(kept[i] for i in range(120)) >= 117
    assert (kept[2000], kept[2001], kept[2002], kept[2003]) == (False, False, True, True)
    assert quality.classify(docs.where("doc_id < 0"), labels).count() == 0
    assert quality.classify(docs, labels.where("doc_id < 0")).where("kept").count() == len(good) + len(bad) + 3


def test_quality_deals_ngrams_out_once(spark, monkeypatch):
    """The blocks' distinct 4-grams are made and shuffled once for the model and for the way back."""
    plans, stored = [], quality.stored

    def seen(df, name):
        if name == "perplexities":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return stored(df, name)

    monkeypatch.setattr(quality, "stored", seen)
    draw = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(draw.choice("abcde ") for _ in range(80)), "en") for i in range(60)], "doc_id long, text string, lang string")
    assert quality.classify(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"), block_bytes=500).count() == 60
    assert len(plans) == 1 and plans[0].count("FlatMapGroupsInArrow") == 1


def test_quality_held_out(spark):
    draw = random.Random(10)
    names = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 9))) for _ in range(3000)]
    write = lambda n: " ".join(draw.choice(names) for _ in range(n))
    rows = [(i, "en", write(150)) for i in range(90)] + [(1000, "it", write(150)), *[(1001 + i, "it", write(150)) for i in range(10)]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(1000, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, spread=0.3, block_bytes=30_000).collect()}
    assert sum(got[i].kept for i in range(30, 90)) >= 55  # unseen clean texts, though the trusted ones are few
    assert all(got[1000 + i].kept and got[1000 + i].limit is None for i in range(11))


def test_probabilities_sum_to_one(spark):
    draw = random.Random(2)
    texts = spark.createDataFrame([("x", "".join(draw.choice("ab ") for _ in range(300)))], "lang string, text string")
    model = quality.train(texts)
    seen = quality._counts(texts).select(F.shiftleft(F.shiftrightunsigned("key", 16), 16).alias("head")).distinct().limit(3)
    alphabet = spark.createDataFrame([(ord(c),) for c in "ab "], "c long")
    types = seen.crossJoin(alphabet).select(F.lit("x").alias("lang"), (F.col("head") + F.col("c")).alias("key"))
    sums = quality.log_probabilities(types, model).groupBy(F.shiftrightunsigned("key", 16)).agg(F.sum(F.exp("logp")).alias("p")).collect()
    floor = model[0][0].first()["floor"]
    assert all(1 - floor < r.p <= 1.0000001 for r in sums)  # the rest is for unseen characters


def _plain_kneser_ney(texts, order=4):
    """Interpolated modified Kneser-Ney over characters, by dicts: a function of a context of three characters and the next one."""
    counts = {order: {}}
    for t in texts:
        t = "   " + " ".join(t.split())
        for i in range(order, len(t) + 1):
            counts[order][t[i - order : i]] = counts[order].get(t[i - order : i], 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for gram in counts[n + 1]:
            counts[n][gram[1:]] = counts[n].get(gram[1:], 0) + 1
    held = {}
    for n, grams in counts.items():
        n1, n2, n3, n4 = (sum(c == i for c in grams.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else None
        raw = [i - (i + 1) * y * b / a if a and y is not None else None for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        held[n] = [max(0.05, min(0.5 * i if d is None else d, 0.95 * i)) for i, d in zip((1, 2, 3), raw)]

    def p(context, c):
        value = 1 / (len(counts[1]) + 1)
        for n in range(1, order + 1):
            h = context[len(context) - n + 1 :]
            after = {g: k for g, k in counts[n].items() if g[:-1] == h}
            if after:
                d = lambda k: held[n][min(k, 3) - 1]  # noqa: B023, E731
                whole, own = sum(after.values()), after.get(h + c, 0)
                value = (own - d(own) if own else 0) / whole + sum(map(d, after.values())) / whole * value
        return value

    return p


def test_quality_equals_plain_kneser_ney(spark):
    """Perplexities of all documents, by the whole model and by those without a fold, are those of a plain model; the limits and decisions follow."""
    draw = random.Random(12)
    write = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    rows = [(i, "xa" if i % 3 else "xb", write("abc  d" if i % 3 else "dé ef", draw.randrange(5, 90)), i) for i in range(60)]
    rows += [(100, "xa", write("abcxyz", 50), 0), (101, "xa", "", 0), (102, "xc", "zzz", 0), (103, None, None, 0), (104, "xb", " \t\n", 0), (5, "xa", rows[5][2], 5), (105, "xb", "e" * 3000, 0)]
    docs = spark.createDataFrame([(*r, True, "7", 1.0, 2) for r in rows], "doc_id long, lang string, text string, n int, trusted boolean, fold string, limit double, chars int")  # names that clash
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40)] + [(3, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels, quantile=0.9, spread=0.5, block_bytes=700).collect()
    assert len(got) == len(rows)
    folds = {r.text: r.f for r in docs.select("text", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(quality.FOLDS)).alias("f")).collect()}
    keys = {r.text: r.k for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    trusted = [r for r in rows if r[0] < 40 and r[0] != 3]
    models, want, held = {}, {}, {}
    for i, lang, text, _ in rows:
        lang = lang or "und"
        leave = folds[text] if i < 40 and i != 3 else None
        base = tuple(t for _, g, t, _ in trusted if g == lang and folds[t] != leave)
        if base and base not in models:
            models[base] = _plain_kneser_ney(base)
        line = " ".join((text or "").split())
        if not base or not line:
            want[i, keys[text]] = None, len(line)
            continue
        whole = "   " + line
        logs = [math.log(models[base](whole[j - 3 : j], whole[j])) for j in range(3, len(whole))]
        want[i, keys[text]] = math.exp(-sum(logs) / len(logs)), len(line)
        if leave is not None:
            held.setdefault(lang, []).append((want[i, keys[text]][0], text))
    assert {(r.doc_id, r.text_key) for r in got} == set(want)
    for r in got:
        perplexity, chars = want[r.doc_id, r.text_key]
        assert (r.perplexity is None) == (perplexity is None) and (perplexity is None or r.perplexity == pytest.approx(perplexity, rel=1e-9))
        if r.lang not in held:
            assert r.limit is None and r.kept == (chars > 0)
            continue
        values = sorted(v for v, _ in held[r.lang])
        limit = values[math.ceil(0.9 * len(values)) - 1] * math.exp(2.0 / len({t for _, t in held[r.lang]}))
        assert r.limit == pytest.approx(limit, rel=1e-9)
        assert r.kept == (perplexity is not None and perplexity <= limit * math.exp(0.5 / math.sqrt(max(chars, 1))))


def test_mixing(spark, docs, texts):
    rows = mixing.mix_documents(docs.where("doc_id is not null"), bins=4).toPandas()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in texts.items()}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in rows.itertuples())
    names = sorted([s for s in rows.source.unique() if isinstance(s, str)]) + [None]
    total = {s: int(rows[rows.source.isna() if s is None else rows.source == s]["size"].sum()) for s in names}
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    for s in names:
        part = rows[rows.source.isna() if s is None else rows.source == s]
        want = 2 * total[s] if s in full else level * weight[s]
        assert part.target.iloc[0] == pytest.approx(want) and abs(part.taken.sum() - want) <= 1
        assert (part.source_size == total[s]).all()
    again = mixing.mix_documents(docs.where("doc_id is not null").repartition(5), bins=4).toPandas()
    order = ["doc_id", "taken"]
    assert rows.sort_values(order)[order].values.tolist() == again.sort_values(order)[order].values.tolist()
    copies = mixing.copies_of(mixing.mix_documents(docs.where("doc_id is not null"), bins=4), ["doc_id", "text", "n_chars"])
    assert copies.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == rows.taken.sum()
    assert mixing.mix_documents(docs.where("doc_id < 0")).count() == 0


def _word_sets(texts):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_ngram_join(spark, docs, texts):
    draw = random.Random(6)
    more = dict(texts)
    base = _words(draw, 60).split()
    for i in range(40):  # a group of near copies that differ from each other
        w = list(base)
        for _ in range(draw.choice([1, 1, 2, 3])):
            w[draw.randrange(60)] = draw.choice(WORDS) + "x"
        more[700 + i] = " ".join(w)
    extra = spark.createDataFrame([(k, more[k], "en", "a", 1, 1, "x") for k in more if k >= 700], DOC)
    sets = _word_sets(more)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _groups(links, list(sets))
    for block, family, rounds in ((200_000, 8192, 3), (300, 8192, 0), (300, 1, 2)):
        got = ngram_join.ngram_components(docs.unionByName(extra), block_elements=block, family_rows=family, rounds=rounds).where("doc_id is not null").collect()
        assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == {k: len(s) for k, s in sets.items()}
    assert want[503] == want[504] == 503 and want[500] == 500
    assert ngram_join.ngram_components(docs.where("doc_id < 0")).count() == 0


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _base(text):
    out = []
    for kind, pattern in zip(pii.KINDS, BASE, strict=True):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    draw = random.Random(13)
    texts = ["a@b@c.de x.y+z@h-1.org.", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.003.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 123-4567 89 +1 2", "é +4 @ 😀 me@x.yz", "", None, "a" * 5000 + "@", "1" * 3000]
    texts += ["".join(draw.choice("a1.@+- 5(4)") for _ in range(60)) for _ in range(300)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = _base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].spans.split(",")[: len(want.split(","))] == want.split(","), t


def test_disclosing_terms(spark):
    draw = random.Random(14)
    rows = [(i, f"{_words(draw, 20)} write to Zorvak at zz@mail.example {_words(draw, 20)}") for i in range(6)] + [(10 + i, _words(draw, 30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_pii(docs)
    got = {r.doc_id: r.spans for r in found.collect()}
    at = rows[0][1].index("Zorvak")
    assert f"gone:{at}:{at + 6}" in got[0] and got[10] == "" and got[0].startswith("email:")
    clean = pii.sanitise(docs.join(found.select("doc_id", "spans"), "doc_id"))
    text = clean.where("doc_id = 0").first()["text"]
    assert "Zorvak" not in text and "[EMAIL]" in text
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(6)] + rows[6:], "doc_id long, text string")
    assert "gone" not in "".join(r.spans for r in pii.find_pii(copies).collect())  # copies of one text support nothing
    assert pii.find_pii(docs.where("doc_id < 0")).count() == 0


def test_terms_far_from_their_entity(spark):
    draw = random.Random(15)
    rows = [(i, f"Zorvak {_words(draw, 30)} zz@mail.example {_words(draw, 30)} ZORVAK") for i in range(6)] + [(10 + i, _words(draw, 30)) for i in range(200)]
    rows += [(500, "x Zorvak y"), (500, "x Zorvak y")]
    got = {r.doc_id: r.spans.split(",") for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        n = len(rows[i][1])
        assert "gone:0:6" in got[i] and f"gone:{n - 6}:{n}" in got[i]
    assert got[500] == ["gone:2:8"]  # of 8 rows with the term, 6 hold the entity
    assert pii.words_of("a@bc.de xy Xy") == {"xy": [(8, 10), (11, 13)]}


def test_keep_distinct_rows(spark):
    import corpus_pipeline

    draw = random.Random(22)
    a, b, c, d = (_words(draw, 40) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, c), (None, c), (None, d), (None, d), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, docs.repartition(3), "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (3, c), (None, d), (4, ""), (4, ""), (None, None)], key=str)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(21)
    rows = [(i, "\n".join(_words(draw, 25) + "." for _ in range(4)), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "a", 1), (101, "#$%^&*" * 60, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    good = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert sorted(good.columns) == sorted(docs.columns) and {r.doc_id for r in good.collect()} == set(range(40)) | {100}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= set(range(40)) and out.groupby("sequence_id").length.sum().max() <= 2048


def test_disclosure_values(spark):
    """Every term's disclosure against plain counts; common terms are left out by the bound only."""
    draw = random.Random(16)
    vocabulary = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for i in range(160):
        words = [draw.choice(vocabulary) for _ in range(12)]
        person = draw.randrange(12)
        if person < 5:
            words += [f"p{'abcde'[person]}{draw.choice('xy')}", f"{'abcde'[person]}@mail.example"]
        rows.append((i, " ".join(words)))
    rows += [(900, rows[0][1]), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(pii.distinct_words(t or ""), {t[s:e] for of in pii.spans(t or "") for s, e in of}, t) for _, t in rows]
    best: dict = {}
    for e in {e for _, found, _ in sets for e in found}:
        with_e = [x for x in sets if e in x[1]]
        if len({x[2] for x in with_e}) < 3:
            continue
        for w in {w for x in with_e for w in x[0]}:
            both = [x for x in with_e if w in x[0]]
            if len({x[2] for x in both}) >= 3:
                d = np.log(len(both) * len(rows) / (sum(w in x[0] for x in sets) * len(with_e))) / np.log(len(rows) / len(with_e))
                best[w] = max(best.get(w, -9), d)
    some = pii._base(docs).where("n_email > 0")
    for least in (0.0, 0.5, 0.8):
        got = {r.term: r.disclosure for r in pii.disclosures(some, docs, 3, least).collect()}
        want = {w: d for w, d in best.items() if d >= least}
        assert got == pytest.approx(want) and (want or least > 0.5)


def test_clashing_names(spark):
    rows = [(i, f"word{i} and more words here\nline {i} of the text that is long enough", "ab"[i % 2]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = ["_of", "_h", "_bin", "_w", "_r", "_whole", "_room", "tilt", "mean", "of", "row_key", "row", "gone", "_gone", "_hit", "_word", "_bits", "line", "pos", "c0", "in_0"]
    wide = docs.select("*", *[F.lit(f"{c}!").alias(c) for c in odd])
    for out in (mixing.mix_documents(wide, bins=4), line_dedup.dedup_lines(wide)):
        got = out.collect()
        assert len(got) == 6 and all(r[c] == f"{c}!" for r in got for c in odd) and set(wide.columns) <= set(out.columns)


def test_topk_repeated_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (1, [3, 0]), (2, [2, 1]), (3, [1, 1])]
    q = spark.createDataFrame(rows, "vec_id long, q array<long>")
    got = topk.top_k(q, q.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 3), (0, 2, 2, 2), (0, 3, 3, 1)]


def test_tally_holds_few_keys():
    """Counts of 4-grams, whose memory doesn't grow with the texts of a batch."""
    import tracemalloc

    draw = random.Random(8)
    texts = [(draw.choice(["en", "de", None]), " ".join(draw.choice(["ab", "cd", "efg", "h"]) for _ in range(400))) for _ in range(5000)] + [("en", ""), ("x", " ")]
    plain: dict = {}
    for lang, text in texts[:200] + texts[-2:]:
        plain.setdefault(lang, Counter()).update(quality.gram_keys(text).tolist())
    got = quality.tally(iter(texts[:200] + texts[-2:]))
    assert {lang: dict(zip(key.tolist(), c.tolist(), strict=True)) for lang, (key, c) in got.items()} == {lang: dict(c) for lang, c in plain.items()}
    tracemalloc.start()
    whole = quality.tally(iter(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    chars = sum(int(c.sum()) for _, c in whole.values())
    assert chars > 4 * quality.HELD and most < 5 * 8 * quality.HELD  # all keys and their sorted copy take twice 8 bytes a character


def test_line_sets_need_no_sort(spark):
    lines = spark.createDataFrame([(1, "abcdefghij" * 3), (2, "short"), (3, "𝒳abcdefgh")], "line_id long, line string")
    sets = line_dedup.shingle_sets(lines, 8)
    assert "Aggregate" not in sets._jdf.queryExecution().executedPlan().toString()
    known = {r.line_id: r for r in line_dedup.sketches(sets).collect()}
    for r in sets.collect():
        assert len(set(r.shingles)) == len(r.shingles) == known[r.line_id].n == {1: 10, 2: 1, 3: 3}[r.line_id]
        words = [0] * line_dedup.SKETCH
        for h in r.shingles:
            words[(h >> 8) & (line_dedup.SKETCH - 1)] ^= 1 << (h & 63)
        assert [known[r.line_id][f"b{w}"] & (2**64 - 1) for w in range(line_dedup.SKETCH)] == words


def test_line_sets_take_linear_time(spark):
    import time

    draw = random.Random(9)
    long = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=400_000))
    lines = spark.createDataFrame([(1, long), (2, long[:5000])], "line_id long, line string")
    began = time.time()
    sizes = dict(line_dedup.shingle_sets(lines, 8).select("line_id", F.size("shingles")).collect())
    assert time.time() - began < 15  # a copy of the line for each shingle would move 320 GB
    assert 399_900 < sizes[1] <= 399_993 and sizes[2] == 4993


def test_stored_tables_free_the_driver(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(common, "free_shuffles", freed.append)
    for _ in range(2 * common.FREED_EVERY):
        common.forget(common.stored(spark.range(3).toDF("v"), "freed"))
    assert len(freed) == 2
