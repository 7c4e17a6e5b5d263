"""Expectations of the curation operators, table by table."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.config import Settings
from sievemill.functions import embed, replies, shingles
from sievemill.operators import coverage, dedup, diversity, requests, sampling, scoring, similarity, spectrum
from sievemill.sources import band_index, tables, taxonomy


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "shop.json").write_text(json.dumps({"topic": ["a", "b"], "tone": ["x", "y", "z"]}))
    (tmp_path / "arts.json").write_text(json.dumps({"topic": ["q"]}))
    rows = taxonomy.load_taxonomy(spark, str(tmp_path), "shop").orderBy("dimension", "ordinal").collect()
    assert [(r.dimension, r.value, r.ordinal) for r in rows] == [("tone", "x", 0), ("tone", "y", 1), ("tone", "z", 2), ("topic", "a", 0), ("topic", "b", 1)]
    assert [r.domain for r in taxonomy.list_domains(spark, str(tmp_path)).collect()] == ["arts", "shop"]
    with pytest.raises(taxonomy.TaxonomyError):
        taxonomy.load_taxonomy(spark, str(tmp_path), "none")


def test_taxonomy_violations(spark, tmp_path):
    bad = {"list": "[]", "empty": "{}", "none": '{"a": []}', "text": '{"a": "b"}', "blank": '{"a": [""]}', "number": '{"a": [1, "x"]}', "twice": '{"a": ["x", "x"]}', "broken": '{"a": [', "noname": '{"": ["x"]}', "good": '{"a": ["x, y", "z"]}'}
    rows = spark.createDataFrame(list(bad.items()), "domain string, doc string")
    found = {r.domain for r in taxonomy.violations(rows).collect()}
    assert found == set(bad) - {"good"}


def test_slug_and_generic(spark):
    rows = spark.createDataFrame([("  Pet Food & Toys!! ",), ("",), ("Ünï-x",)], "s string").select(taxonomy.slug("s")).collect()
    assert [r[0] for r in rows] == ["pet_food_toys", "custom", "ünï_x"]
    sizes = {r.dimension: r["count"] for r in taxonomy.generic_taxonomy(spark, "d").groupBy("dimension").count().collect()}
    assert sizes == {"reader": 5, "answer_length": 3, "answer_form": 4, "knowledge_needed": 3}


def _taxonomy(spark):
    return spark.createDataFrame([("d", "topic", v, i) for i, v in enumerate("abcde")] + [("d", "tone", v, i) for i, v in enumerate("xyz")], taxonomy.SCHEMA)


def test_sampling(spark):
    tax = _taxonomy(spark)
    one = sampling.sample_node_sets(tax, "d", 20, 3, seed=1)
    rows = one.orderBy("idx").collect()
    assert [r.node_id for r in rows] == [f"d-{i:06d}" for i in range(20)]
    counts = coverage.coverage(one).collect()
    assert len(counts) == 8 and min(r.n for r in counts) >= 3
    again = sampling.sample_node_sets(tax.repartition(7), "d", 20, 3, seed=1).orderBy("idx").collect()
    assert rows == again
    assert rows != sampling.sample_node_sets(tax, "d", 20, 3, seed=2).orderBy("idx").collect()
    for n in (16, 18, 23):  # a larger sample only adds scenarios
        assert sampling.sample_node_sets(tax, "d", n, 3, seed=1).orderBy("idx").collect() == (rows + sampling.sample_node_sets(tax, "d", 23, 3, seed=1, start=20).orderBy("idx").collect())[:n]
    with pytest.raises(sampling.CoverageError, match="topic"):
        sampling.sample_node_sets(tax, "d", 14, 3)
    assert sampling.sample_node_sets(tax, "d", 7, 3, strict=False).count() == 7
    with pytest.raises(sampling.CoverageError):
        sampling.sample_node_sets(tax, "d", 0)
    assert sampling.plan_size(100, 3, 5) == (150, 3) and sampling.plan_size(1, 3, 4, ad_hoc=True) == (2, 1)


def test_permuted(spark):
    """Every size of a dimension is permuted, each cycle in its own way."""
    rows = spark.range(0, 60).select(F.col("id").alias("x"), F.explode(F.array(*[F.lit(c) for c in (1, 2)])).alias("cycle"))
    orders = set()
    for k in (1, 2, 3, 5, 12, 37):
        a = math.ceil(math.sqrt(k))
        at = sampling.permuted(F.col("x"), F.lit(k).cast("long"), F.lit(a).cast("long"), F.lit(math.ceil(k / a)).cast("long"), F.lit(7), F.col("cycle"))
        got = rows.where(F.col("x") < k).select("cycle", at.alias("at")).groupBy("cycle").agg(F.collect_list("at").alias("at")).collect()
        assert all(sorted(r["at"]) == list(range(k)) for r in got)
        orders |= {tuple(r["at"]) for r in got if k == 37}
    assert len(orders) == 2


def test_requests(spark):
    rows = spark.createDataFrame([("e1", 0, 0, 'say "hi"\n', "ok"), ("e2", 0, 1, "b", None)], "example_id string, part int, o int, prompt string, completion string")
    batched = requests.screening_batches(rows, "part", ["o"], 3)
    prompt = requests.screening_requests(batched, "part").first()["prompt"]
    lines = [json.loads(x) for x in prompt.split("\n")[1:-1]]
    assert lines == [{"id": 0, "instruction": 'say "hi"\n', "response": "ok"}, {"id": 1, "instruction": "b", "response": ""}]
    assert requests.scoring_requests(rows).where("role = 'scorer'").count() == 2
    nodes = spark.createDataFrame([("n", "d", {"b": "2", "a": "1"}, "My brief")], "node_id string, domain string, dimensions map<string,string>, use_case string")
    assert '{"a": "1", "b": "2"}' in requests.generation_requests(nodes).first()["prompt"]


@pytest.mark.parametrize(
    ("text", "n"),
    [('[{"a":1}]', 1), ('```json\n[{"a":1},{"b":2}]\n```', 2), ('Sure: [{"a":1}] done', 1), ("garbage", 0), ("", 0), (None, 0), ('[{"a":1}, "x", 3]', 1), ('{"a":[{"b":1}]}', 0)],
)
def test_array_items(text, n):
    assert len(replies.array_items(text)) == n


def test_parse_examples(spark):
    items = [{"instruction": "i", "response": "r"}, {"prompt": "p", "completion": 5}, {"instruction": "", "response": "r"}, {"instruction": "x"}]
    rows = spark.createDataFrame([("n1", json.dumps(items)), ("n2", "no")], "node_id string, reply string")
    got = replies.parse_examples(rows).orderBy("pos").collect()
    assert [(r.prompt, r.completion) for r in got] == [("i", "r"), ("p", "5")]
    assert len({r.example_id for r in got}) == 2


def test_verdicts(spark):
    text = '[{"id": 0, "pass": true}, {"id": "1", "pass": 1}, {"id": 2, "pass": "maybe"}, {"id": 7, "pass": true}, {"pass": true}, "x", {"id": 0, "pass": false}, {"id": Infinity, "pass": true}]'
    rows = spark.createDataFrame([(1, text, 3)], "batch int, reply string, size int")
    got = {r.id: r.passed for r in replies.parse_verdicts(rows, "reply", ["batch"], "size").collect()}
    assert got == {0: False, 1: True}
    batched = spark.createDataFrame([(1, i) for i in range(3)], "batch int, pos int")
    scored = scoring.screened(batched, replies.parse_verdicts(rows, "reply", ["batch"], "size"), ["batch"])
    assert [r.prefilter_score for r in scored.orderBy("pos").collect()] == [0.0, 1.0, 0.0]


@pytest.mark.parametrize(
    ("text", "rubric"),
    [
        ('{"factuality": 4, "bogus": 3}', {"factuality": 4}), ('Here ```json\n{"factuality": 9, "response_quality": -2}\n``` ok', {"factuality": 5, "response_quality": 1}),
        ('{"factuality": 3.7, "response_quality": 2.5}', {"factuality": 4, "response_quality": 2}), ('{"factuality": "4", "response_quality": true}', {}),
        ('{"factuality": 1} final {"factuality": 5}', {"factuality": 5}), ('x {"factuality": 5} {"note": {"a": 1}}', {"factuality": 5}), ("garbage", {}), ("[1]", {}), ('{"factuality": NaN}', {}),
    ],
)
def test_rubric(text, rubric):
    assert replies.rubric_of(text) == rubric


def test_blocks_and_envelope(spark):
    assert replies.balanced_objects('so: {"k": [4]} and }} or {"m": {"n": {}}}.') == ['{"k": [4]}', '{"m": {"n": {}}}']
    rows = spark.createDataFrame([('{"choices":[{"message":{"content":"x"}}]}',), ("{}",), ('{"choices":[]}',), (None,)], "r string")
    assert [r[0] for r in rows.select(replies.envelope_content("r")).collect()] == ["x", "", "", ""]


def test_scores(spark):
    five = ["factuality", "instruction_clarity", "response_quality", "domain_relevance", "format_compliance"]
    cases = [((5,) * 5, 5.0, "accept"), ((1,) * 5, 1.0, "reject"), ((2, 4, 5, 3, 4), 3.5, "accept"), ((3,) * 5, 3.0, "revise"), ((4, 5, 3, 5, 5), 4.2, "accept")]
    rows = spark.createDataFrame([(i, dict(zip(five, c[0], strict=True))) for i, c in enumerate(cases)], "i int, rubric map<string,int>")
    got = scoring.judged(rows).orderBy("i").collect()
    assert [(r.composite_score, r.verdict) for r in got] == [(c[1], c[2]) for c in cases]
    h = spark.createDataFrame([(x,) for x in (350, 349, 345, 341, 340, 300, 299)], "h int")
    assert [r[0] for r in h.select(scoring.verdict(F.col("h"))).collect()] == ["accept", "reject", "reject", "reject", "revise", "revise", "reject"]
    assert h.where("h = 345").select(scoring.verdict(F.col("h"), Settings(gap_policy="revise"))).first()[0] == "revise"
    empty = spark.createDataFrame([({},), (None,)], "rubric map<string,int>")
    assert {(r.composite_score, r.verdict) for r in scoring.judged(empty).collect()} == {(0.0, "reject")}


def test_ngrams(spark):
    rows = spark.createDataFrame([("abcdef", 3), ("ABC", 2), ("ab", 5), ("", 5), ("a\nb😀c", 2)], "t string, n int").collect()
    got = [spark.createDataFrame([(r.t,)], "t string").select(shingles.ngrams("t", r.n)).first()[0] for r in rows]
    assert got == [["abc", "bcd", "cde", "def"], ["ab", "bc"], ["ab"], [], ["a\n", "\nb", "b😀", "😀c"]]


def test_text_signature(spark):
    """Signed by groups of texts as by one text's n-grams at a time: short, empty and null texts, signs of two code units, many letters, texts of several groups."""
    draw = random.Random(8)
    wide = "".join(chr(0x4E00 + i) for i in range(6000))
    texts = [None, "", "a", "abcd", "ABCDE", "abcdef", "\U0001f600\U0001f601 x\U0001f600y\u0130", "aaaaaaaaaa", wide, wide[::-1], "ab c" * 300_000, "".join(draw.choice("abcdefgh \n") for _ in range(600_000))]
    texts += ["".join(draw.choice("abc é\x00") for _ in range(draw.randrange(200))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    plain = {r.id: r.s for r in rows.select("id", shingles.signature(shingles.gram_hashes(shingles.ngrams("t"))).alias("s")).collect()}
    got = {r.id: r.s for r in rows.select("id", shingles.text_signature("t").alias("s")).collect()}
    assert got == plain and got[0] is None and got[1] is None


def test_signing_shuffles_no_text(spark):
    rows = spark.range(5).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    assert "Exchange" not in band_index.text_buckets(rows, "id", "t")._jdf.queryExecution().executedPlan().toString()


def test_first_wins_equals_the_sequential_loop(spark):
    draw = random.Random(3)
    for _ in range(3):
        n = 40
        buckets = [(draw.randrange(n), f"b{draw.randrange(25)}") for _ in range(70)]
        of = {}
        for o, b in buckets:
            of.setdefault(o, set()).add(b)
        kept, taken = set(), set()
        for o in range(n):
            if not of.get(o, set()) & taken:
                kept.add(o)
                taken |= of.get(o, set())
        got = dedup.first_wins(spark.range(n).withColumnRenamed("id", "ord"), spark.createDataFrame(buckets, "ord long, bucket string"))
        assert {r.ord for r in got.collect()} == kept


def test_first_wins_by_ranges(spark):
    """However many ranges: random buckets, and a chain of 5,000 rows, which takes few jobs."""
    draw = random.Random(4)
    buckets = sorted({(draw.randrange(300), f"b{draw.randrange(250)}") for _ in range(700)})
    by: dict = {}
    for o, b in buckets:
        by.setdefault(o, []).append(b)
    taken, kept = set(), set(range(300)) - set(by)
    for o in sorted(by):
        if not taken & set(by[o]):
            kept.add(o)
            taken |= set(by[o])
    rows, df = spark.range(300).withColumnRenamed("id", "ord"), spark.createDataFrame(buckets, "ord long, bucket string")
    for size in (1000, 90, 20):
        got = [r.ord for r in dedup.first_wins(rows, df, range_rows=size).collect()]
        assert len(got) == len(kept) and set(got) == kept
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("ord"), F.explode(F.expr("array(string(id), string(id + 1))")).alias("bucket"))
    for size in (1 << 20, 2500):
        spark.sparkContext.setJobGroup(f"chain-{size}", "first wins")
        got = sorted(r.ord for r in dedup.first_wins(spark.range(n).withColumnRenamed("id", "ord"), chain, range_rows=size).collect())
        assert got == list(range(0, n, 2))
        if size > 2 * n:
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{size}")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_two_layers(spark):
    u = np.eye(8).tolist()
    rows = [(0, "the quick brown fox jumps over the lazy dog", u[0]), (1, "the quick brown fox jumps over the lazy dog", u[1]), (2, "something else altogether here", u[0]), (3, "a third and quite different text", u[3]), (4, None, u[5]), (5, "words no other row has in it", None)]
    df = spark.createDataFrame(rows, "ord long, text string, vector array<double>")
    got = {r.ord: r.reason for r in dedup.deduplicate(df).collect()}
    assert got == {0: None, 1: "minhash", 2: "cosine", 3: None, 4: None, 5: None}
    stored = spark.createDataFrame([("s", u[3])], "id string, vector array<double>")
    assert {r.ord: r.reason for r in dedup.deduplicate(df, stored_vectors=stored).collect()}[3] == "cosine"
    assert dedup.deduplicate(df.where("ord < 0")).count() == 0


def test_equal_vectors_and_widths(spark):
    """Copies of a vector collide with each other and with all that their vector is linked to; zero vectors have no cosine."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 6))
    base[1] = base[0] + 0.01
    base[2] = 0
    which = [int(x) for x in draw.integers(0, 12, 80)]
    rows = [(i, f"{i} " + "".join(chr(int(c)) for c in draw.integers(97, 123, 40)), base[w].tolist()) for i, w in enumerate(which)]
    for metric in ("cosine", "proxy_l2sq"):
        kept: list = []
        for i, w in enumerate(which):
            x, ys = base[w], base[[which[k] for k in kept]].reshape(-1, 6)
            near = ys @ x / np.maximum(np.linalg.norm(ys, axis=1) * np.linalg.norm(x), 1e-300) if metric == "cosine" else 1 / (1 + ((ys - x) ** 2).sum(1))
            if not (near >= 0.92).any():
                kept.append(i)
        got = dedup.deduplicate(spark.createDataFrame(rows, "ord long, text string, vector array<double>"), metric=metric)
        assert [r.ord for r in got.where("reason is null").orderBy("ord").collect()] == kept and len(kept) < 80
    odd = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0, 2.0])], "ord long, text string, vector array<double>")
    with pytest.raises(ValueError, match="different dimensions: 1 and 2"):
        dedup.deduplicate(odd)
    with pytest.raises(ValueError, match="different dimensions"):
        dedup.deduplicate(odd.where("ord = 0"), stored_vectors=odd.where("ord = 1").select(F.lit("s").alias("id"), "vector"))


def test_pairs_of_blocks(spark):
    x = np.random.default_rng(1).normal(size=(90, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if unit[i] @ unit[j] >= 0.8}
    got = similarity.similar_vectors(rows, rows, "cosine", 0.8, block=20, half=True).collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want


def test_blocks_grow_with_the_table(spark):
    """A row travels 16 times however many rows there are, until a block would be too large for a task; equal neighbours give the smallest id."""
    rows = spark.range(200_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("float")).alias("vector"))
    assert similarity._blocks(rows, None) == similarity.SIDES and similarity._blocks(rows.limit(1000), None) == 1 and similarity._blocks(rows, 10_000) == 20
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "id long, vector array<float>")
    got = {r.left_id: (r.right_id, r.similarity) for r in similarity.similar_vectors(same, same, block=7).collect()}
    assert got == {i: (int(i == 0), 1.0) for i in range(40)}
    with pytest.raises(Exception, match="different dimensions"):
        similarity.similar_vectors(same, same.unionByName(spark.createDataFrame([(99, [1.0])], same.schema))).collect()


def test_jaccard_links_against_all_pairs(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcd ") for _ in range(60)) for _ in range(6)]
    texts = sorted({t[:k] + draw.choice("xyz") + t[k:] for t in base for k in (0, 10, 55)} | set(base))
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(grams[i] & grams[j]) >= 0.7 * len(grams[i] | grams[j])}
    got = similarity.jaccard_links(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert {(r.a, r.b) for r in got.collect()} == want and want


def test_jaccard_links_meet_by_sketches(spark, monkeypatch):
    """Many classes of size and many blocks of a class lose no link and meet no pair twice; texts that share most of their n-grams without a link aren't compared by n-grams."""
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    texts = {"x", "ab", "abcde", "abcdef", "\U0001f600abcd", "", None}
    for size in (3, 8, 20, 60, 150, 400):
        for _ in range(25):
            t = [draw.choice(words) for _ in range(size)]
            texts |= {" ".join(t), " ".join([*t[: -1 - size // 8], "zz"]), " ".join(t[: size * 3 // 4])}
    texts = sorted(texts, key=str)
    grams = [{t.lower()[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(grams) for j, b in enumerate(grams) if i < j and a and b and len(a & b) >= 0.7 * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    monkeypatch.setattr(similarity, "SKETCHES", 512)
    found, stored = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: (found.append((name, stored(df, name))), found[-1][1])[1])
    got = similarity.jaccard_links(docs, "id", "t").collect()
    assert {(r.a, r.b): r.jaccard for r in got} == want and len(got) == len(want) > 100
    assert dict(found)["near"].count() < 3 * len(want)
    assert similarity.jaccard_links(docs.where("id < 0"), "id", "t").count() == 0


def test_jaccard_links_travel_once(spark, monkeypatch):
    """However many blocks a row meets, its sketch lies in one of them and isn't copied for the others; the texts of a group of near copies travel to one place, or to several if they are many."""
    draw = random.Random(11)
    texts = []
    for size, copies in ((30, 12), (60, 9), (200, 7), (40, 1), (45, 1), (80, 40)):
        t = [draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size * 5)]
        texts += ["".join([*t[:k], draw.choice("XYZ"), *t[k + 1 :]]) for k in draw.sample(range(size), copies)]
    grams = [{t.lower()[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(grams) for j, b in enumerate(grams) if i < j and len(a & b) >= 0.7 * len(a | b)}
    name = lambda i: f"k{i:03}"
    docs = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)] + [(name(900 + i), t) for i, t in enumerate(texts)], "id string, t string").repartition(3)
    monkeypatch.setattr(similarity, "SKETCHES", 256)
    found, plans, stored = {}, [], similarity.written

    def written(df, at):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        found[at] = stored(df, at)
        return found[at]

    monkeypatch.setattr(similarity, "written", written)
    monkeypatch.setattr(similarity, "delete", lambda *tables: None)
    for characters, pairs, keys in ((1 << 22, 1 << 17, 1 << 20), (1 << 11, 1 << 17, 1 << 20), (1 << 22, 20, 10)):
        monkeypatch.setattr(similarity, "VERIFIED", characters)
        monkeypatch.setattr(similarity, "PAIRS", pairs)
        monkeypatch.setattr(similarity, "WANTED", keys)
        got = similarity.jaccard_links(docs, "id", "t").collect()
        assert {(r.a, r.b): r.jaccard for r in got} == {(name(i), name(j)): v for (i, j), v in want.items()} and len(got) == len(want) > 700
        assert not [line for plan in plans for line in plan.splitlines() if "Generate" in line and "sketch" in line]
        assert found["blocks"].count() > 10 and found["blocks"].select(F.explode("ids")).count() == found["sketches"].count() == len(texts)
        travels = found["near"].select("p", "q", F.explode(F.array("x", "y")).alias("id")).distinct().count()
        ends = len({k for pair in want for k in pair})
        assert travels == ends if (characters, pairs) == (1 << 22, 1 << 17) else ends < travels < 16 * ends


def test_nearest(spark):
    a = spark.createDataFrame([(1, [0.0] * 4), (2, [10.0] * 4)], "id int, vector array<double>")
    empty = a.where("id < 0")
    assert {r.similarity for r in similarity.nearest_similarity(a, empty).collect()} == {0.0}
    other = a.withColumn("id", F.col("id") + 10)
    assert {r.id: round(r.similarity, 6) for r in similarity.nearest_similarity(a, other).collect()} == {1: 1.0, 2: 1.0}
    with pytest.raises(Exception, match="dimension"):
        tables.checked_vectors(a, 5).collect()


def test_coverage_and_gaps(spark):
    rows = spark.createDataFrame([("d", {"t": "rivers"})] * 2 + [("d", {"t": "lakes"}), ("other", {"t": "rivers"})], "domain string, dimensions map<string,string>")
    assert {(r.value, r.n) for r in coverage.coverage(rows, "d").collect()} == {("rivers", 2), ("lakes", 1)}
    seen = spark.createDataFrame([("x", "a", 7), ("x", "b", 31), ("x", "c", 1)], "dimension string, value string, n long")
    gaps = coverage.gaps(seen, 12)
    assert [(r.value, r.deficit) for r in gaps.collect()] == [("c", 11), ("a", 5)]
    assert coverage.total_deficit(gaps).first()[0] == 16
    assert coverage.gaps(seen, 0).count() == 0 and coverage.gaps(seen, None).count() == 0
    tax = spark.createDataFrame([("x", "z")], "dimension string, value string")
    assert [(r.value, r.deficit) for r in coverage.gaps(seen, 8, tax).collect()] == [("z", 8)]


def test_vendi(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 5))
    rows = [("same", [1.0, 2.0]), ("same", [2.0, 4.0]), ("two", [1.0, 0.0]), ("two", [0.0, 1.0]), ("one", [1.0]), ("zero", [0.0, 0.0]), ("zero", [1.0, 0.0])]
    rows += [("many", v.tolist()) for v in x]
    got = {r.domain: r.score for r in diversity.vendi(spark.createDataFrame(rows, "domain string, vector array<double>").repartition(5)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.linalg.eigvalsh(u @ u.T / 30)
    w = w[w > 1e-12]
    assert got["same"] == pytest.approx(1) and got["two"] == pytest.approx(2) and got["one"] == 0 and np.isfinite(got["zero"])
    assert got["many"] == pytest.approx(np.exp(-(w * np.log(w)).sum()))


def _spectrum(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.sort(np.linalg.eigvalsh(u.T @ u / len(x)))[::-1]


def _entropy_score(w):
    w = w[w > 1e-12]
    return np.exp(-(w * np.log(w)).sum())


def test_vendi_so_far(spark):
    """The scores up to each step, however the steps are cut into ranges: steps of a row, one of many rows, zero vectors, two widths."""
    draw = np.random.default_rng(4)
    steps = [0] * 30 + [s for s in range(1, 40) for _ in range(1 + s % 3)] + [40] * 90 + [41, 41, 45]
    x = draw.normal(size=(len(steps), 6))
    x[5] = 0
    rows = spark.createDataFrame([(s, v.tolist()) for s, v in zip(steps, x, strict=True)] + [(3, [1.0, 0.0]), (9, [0.0, 2.0]), (4, None)], "step long, vector array<float>").repartition(3)
    unit = x.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = {}
    for s in set(steps):
        part = unit[[t <= s for t in steps]]
        w = np.linalg.eigvalsh(part.T @ part / len(part))
        w = w[w > 1e-12]
        want[s, len(part)] = float(np.exp(-(w * np.log(w)).sum()))
    want |= {(3, 1): 0.0, (9, 2): 2.0}
    for size in (1, 12, 50, 10_000):
        got = [((r.step, r.n), r.score) for r in diversity.vendi_so_far(rows, size).collect()]
        assert len(got) == len(want) and dict(got).keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got)
    assert diversity.vendi_so_far(rows.where("step < 0")).count() == 0


def test_sketched_vendi(spark):
    """Exact where the sketch has room for all directions, else within its own error; however rows are dealt."""
    rng = np.random.default_rng(5)
    sets = {"low": rng.normal(size=(300, 6)) @ rng.normal(size=(6, 40)), "full": rng.normal(size=(300, 40)) * np.linspace(3, 0.1, 40), "pair": np.eye(40)[:2]}
    rows = [(d, v.tolist()) for d, x in sets.items() for v in x] + [("alone", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("zero", [2.0, 0.0]), ("nothing", [0.0]), ("nothing", [0.0]), ("low", None), (None, [])]
    df = spark.createDataFrame(rows, "domain string, vector array<double>")
    exact = {r.domain: r.score for r in diversity.vendi(df).collect()}
    for parts in (1, 23):  # one task; more than FAN_IN squared of partial sketches meet in rounds
        dealt = df.repartition(parts)
        for size in (64, 10):
            got = {r.domain: r for r in spectrum.vendi(dealt, size).collect()}
            assert got.keys() == exact.keys() and {d: r.n for d, r in got.items()} == {"low": 300, "full": 300, "pair": 2, "alone": 1, "zero": 2, "nothing": 2}
            for d in set(exact) - ({"full"} if size == 10 else set()):
                assert got[d].score == pytest.approx(exact[d], abs=1e-6) and got[d].error == pytest.approx(0, abs=1e-9)
        r = got["full"]
        assert 0 < r.error <= 1 / 11 and r.low <= exact["full"] <= r.high and r.low <= r.score <= r.high <= 40.001
        s = {r.domain: r for r in spectrum.sketches(dealt, 10).collect()}["full"]
        below = _spectrum(sets["full"])[:10] - np.linalg.svd(np.array(s.rows).reshape(-1, 40), compute_uv=False)[:10] ** 2 / 300
        assert len(s.rows) <= 10 * 40 and (below > -1e-9).all() and (below <= s.cut / 300 + 1e-9).all()
    assert spectrum.vendi(df.where("false")).count() == 0


def test_sketches_go_out_early(spark):
    """A task that meets many domains sends sketches out before its end; nothing is lost."""
    rng = np.random.default_rng(6)
    rows = [(str(i % 40), v.tolist()) for i, v in enumerate(rng.normal(size=(800, 8)))]
    df = spark.createDataFrame(rows, "domain string, vector array<double>").coalesce(1)
    parts = spectrum.partial_sketches(df, 4, held=4).collect()
    assert sum(r.n for r in parts) == 800 and len({r.number for r in parts}) == len(parts) > 0 and all(len(r.rows) <= 4 * 8 for r in parts)
    assert {r.domain: r.n for r in spectrum.sketches(df, 4).collect()} == {str(i): 20 for i in range(40)}


def test_score_bounds():
    """No eigenvalues within the bounds score outside of them, and the bounds are met by some."""
    rng = np.random.default_rng(8)
    w, error = np.array([0.4, 0.2, 0.05, 0.0, 0.0]), 0.1
    low, high = spectrum.score_bounds(w, error, 1.0)
    for _ in range(3000):
        more = rng.random(5) ** rng.integers(1, 6)
        more = np.minimum(more * (1 - w.sum()) / more.sum(), error)
        more += (1 - w.sum() - more.sum()) * (error - more) / (error - more).sum()
        assert low - 1e-9 <= _entropy_score(w + more) <= high + 1e-9
    assert low == pytest.approx(_entropy_score(np.array([0.5, 0.3, 0.15, 0.05, 0.0]))) and high == pytest.approx(_entropy_score(np.array([0.4, 0.25, 0.15, 0.1, 0.1])), rel=0.02)
    assert spectrum.score_bounds(np.array([0.5, 0.5]), 0.0, 1.0) == (pytest.approx(2), pytest.approx(2))


def test_sketch_merges_keep_the_bound():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    b, cut = np.zeros((0, 30)), 0.0
    for at in range(0, 500, 37):
        part, one = spectrum.shrink(x[at : at + 37], 12)
        b, two = spectrum.shrink(np.concatenate([b, part]), 12)
        cut += one + two
    gap = np.linalg.eigvalsh(x.T @ x - b.T @ b)
    assert gap.min() > -1e-9 and gap.max() <= cut + 1e-9 and cut <= 500 / 13
    assert _entropy_score(_spectrum(x)) > 1


def test_embedder(spark):
    rows = spark.createDataFrame([("hello world",), ("hello world",), (None,)], "t string").select(embed.embed(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[0].v) == 384 and sum(rows[2].v) == 0


def test_embedder_gets_few_texts_at_once(spark):
    def factory():
        def model(texts):
            assert len(texts) <= embed.ROWS
            return np.array([[len(t), 1.0] for t in texts])

        return model

    rows = spark.range(0, 2000, 1, 1).withColumn("text", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))))
    got = {r.id: r.v for r in rows.select("id", embed.embed(F.col("text"), factory).alias("v")).collect()}
    assert got == {i: [i % 50 if i % 7 else 0, 1.0] for i in range(2000)}


def test_blocks_stay_as_they_came(monkeypatch):
    """A block of vectors takes four bytes a number; chunks alone become doubles."""
    import tracemalloc

    import pyarrow as pa

    n, width, held = 12_000, 384, {}

    class Rows:  # what similar_vectors asks of a table, to get at its function for a task
        dtypes = [("id", "bigint"), ("vector", "array<float>")]
        select = unionByName = groupBy = lambda self, *_: self

        def applyInArrow(self, run, _):
            held["run"] = run
            return self

    monkeypatch.setattr(similarity, "_blocks", lambda *_: 1)
    monkeypatch.setattr(similarity, "F", type("F", (), {"__getattr__": lambda self, _: lambda *a, **k: self, **{x: lambda self, *_: self for x in ("__call__", "__sub__", "__neg__")}})())
    similarity.similar_vectors(Rows(), Rows(), threshold=0.9)
    draw = np.random.default_rng(3)

    def side(left):
        flat = pa.array(draw.standard_normal(n * width, dtype=np.float32))
        ids = pa.array(np.arange(n) + (0 if left else n - 10)), pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([*(ids if left else ids[::-1]), pa.array([left] * n), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)], names=["a_id", "b_id", "is_left", "vector"])

    batches = [side(True), side(False)]
    tracemalloc.start()
    assert sum(b.num_rows for b in held["run"]((pa.scalar(0), pa.scalar(1)), iter(batches))) == 0
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * n * width * 4 + (55 << 20)
