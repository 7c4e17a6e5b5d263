"""Tables, whole runs and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sievemill.config import Settings
from sievemill.functions import embed, replies
from sievemill.operators import coverage, dedup, scoring
from sievemill.plans import curate as run
from sievemill.plans import domain_run
from sievemill.sources import band_index, tables
from sievemill.streaming import continuous, kept_counts

RUBRIC = {"factuality": 5, "instruction_clarity": 4, "response_quality": 4, "domain_relevance": 4, "format_compliance": 4}


def _examples(spark):
    rows = [("e1", "n1", "नमस्ते", "ok", RUBRIC, 4.3, {"domain": "d", "topic": "a"}, dt.datetime(2025, 3, 9, 8, 15, 42)), ("e2", "n2", "q", "r", RUBRIC, 4.3, {}, dt.datetime(2025, 3, 9, 8, 15, 42))]
    return spark.createDataFrame(rows, "example_id string, node_id string, prompt string, completion string, rubric map<string,int>, composite_score double, taxonomy_node map<string,string>, created_at timestamp")


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_jsonl(_examples(spark), path)
    tables.write_jsonl(_examples(spark), path)
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    one = next(json.loads(x) for x in lines if '"e1"' in x)
    assert one["reasoning_trace"] is None and one["metadata"]["timestamp"] == "2025-03-09T08:15:42Z" and "नमस्ते" in "".join(lines)
    assert tables.read_jsonl(spark, path).count() == 4 and tables.read_jsonl(spark, path, preview=2).count() == 2


def test_example_and_vector_tables(spark, tmp_path):
    path = str(tmp_path / "examples")
    tables.write_examples(_examples(spark), path)
    tables.write_examples(_examples(spark), path)
    assert spark.read.parquet(path).count() == 2
    v = spark.createDataFrame([("a", [1.0, 2.0], 4.0, "d"), ("b", [1.0, 3.0], 4.0, "e")], "id string, vector array<double>, composite_score double, domain string")
    tables.write_vectors(v, str(tmp_path / "v"), 2)
    assert tables.stored_vectors(spark, str(tmp_path / "v"), "d").count() == 1
    with pytest.raises(Exception, match="dimension"):
        tables.write_vectors(v, str(tmp_path / "w"), 3)


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    assert tables.status(spark, path, "d").first()["status"] == "no_checkpoint"
    rows = [("r1", "d", 120, dt.datetime(2026, 1, 1)), ("r1", "d", 220, dt.datetime(2026, 1, 2)), ("r2", "big_d", 5, dt.datetime(2026, 1, 3))]
    tables.append_manifest(spark.createDataFrame(rows, "run_id string, domain string, accepted_count long, timestamp timestamp"), path)
    (tmp_path / "m" / "corrupt.json").write_text("{broken\n")
    got = tables.status(spark, path, "d").first()
    assert (got["status"], got["accepted_count"]) == ("ok", 220)
    with pytest.raises(Exception, match="unsafe"):
        tables.append_manifest(spark.createDataFrame([("../x", "d")], "run_id string, domain string"), path)


def _generated(spark):
    replies_ = [(f"n{i}", i, json.dumps([{"instruction": f"explain topic {i} {'abcdefghij'[i] * 30}", "response": f"answer number {i} {'qrstuvwxyz'[i] * 30}"}, {"instruction": "the very same question about things", "response": "the very same answer about things"}])) for i in range(4)]
    return spark.createDataFrame(replies_, "node_id string, ord long, reply string")


def _judge(examples):
    return scoring.judged(examples.withColumn("prefilter_score", F.lit(1.0)).withColumn("rubric", replies.parse_rubric(F.lit(json.dumps(RUBRIC)))))


def _nodes(spark):
    return spark.createDataFrame([(f"n{i}", "d", {"topic": str(i), "node_id": "own"}) for i in range(3)], "node_id string, domain string, dimensions map<string,string>")


def test_curate(spark):
    kept, counters = run.curate(_generated(spark), _nodes(spark), _judge)
    got = kept.orderBy("ord").collect()
    assert len(got) == 5 and sum("same question" in r.prompt for r in got) == 1
    assert got[0].taxonomy_node["node_id"] == "own" and got[-1].taxonomy_node == {"domain": "", "node_id": "n3"}
    assert {(r.stage, r.outcome): r.n for r in counters.collect()} == {("done", "accepted"): 5, ("dedup", "minhash"): 3}
    assert run.curate(_generated(spark), _nodes(spark), _judge, target=2)[0].count() == 2


def _answers(asked):
    """A generator that answers each node set with one example of its own, and notes what it was asked."""

    def words(n):
        return " ".join(f"{chr(97 + (n * 7 + k * 5) % 26)}{n * 31 + k * k}" for k in range(12))

    def generate(requests):
        got = sorted((r.node_id, r.prompt) for r in requests.collect())
        asked.append(got)
        rows = [(x, int(x[-6:]), json.dumps([{"instruction": words(int(x[-6:]) * 2), "response": words(int(x[-6:]) * 2 + 1)}])) for x, _ in got]
        return requests.sparkSession.createDataFrame(rows, "node_id string, ord long, reply string")

    return generate


def test_next_wave():
    assert domain_run.next_wave(100, 0, 0, 150) == 15  # ten examples a reply
    assert domain_run.next_wave(90, 15, 10, 135) == 135 and domain_run.next_wave(90, 15, 60, 135) == 25
    assert domain_run.next_wave(100, 15, 0, 500) == 30 and domain_run.next_wave(100, 15, 0, 7) == 7
    assert domain_run.next_wave(0, 15, 20, 10) == 0 and domain_run.next_wave(5, 15, 20, 0) == 0


FEW = Settings(checkpoint_every=4, embedding_dim=16, generator_batch=2)


def _run(spark, out, target, generate, judge=_judge, **more):
    tax = spark.createDataFrame([("t", v, i) for i, v in enumerate("abc")], "dimension string, value string, ordinal int")
    return domain_run.run_domain(tax, "d", target, generate, judge, out, seed=3, embedder=embed.hashing_embedder(16), settings=FEW, **more)


def test_domain_run_in_waves_and_resumed(spark, tmp_path):
    """Waves grow by the acceptance so far and stop at the target; a later run goes on with the next number; checkpoints count all of a domain."""
    asked, judged, out = [], [], str(tmp_path / "run")
    generate = _answers(asked)

    def judge(examples):
        judged.append(1)
        return _judge(examples)

    first = _run(spark, out, 10, generate, judge).orderBy("accepted_count").collect()
    assert [len(x) for x in asked] == [8, 3] and [x[0] for w in asked for x in w] == [f"d-{i:06d}" for i in range(11)]
    assert [(r.accepted_count, r.target, r.extra["wave"]) for r in first] == [(4, 10, "1"), (8, 10, "1"), (10, 10, "2")]
    assert [r.rejected_count is None for r in first] == [True, False, False]
    assert sum(first[-1].taxonomy_coverage.values()) == 10 and len(judged) == 2
    assert 1 < first[0].vendi_score < first[-1].vendi_score <= 10
    second = _run(spark, out, 12, generate).collect()
    assert [(r.accepted_count, sum(r.taxonomy_coverage.values())) for r in second] == [(12, 12)]
    assert [x[0] for x in asked[2]] == ["d-000011", "d-000012"]
    steps = tables.committed_steps(spark, f"{out}/manifest", "d")
    assert steps.count() == 3
    records = tables.read_jsonl(spark, f"{out}/jsonl", steps=steps)
    assert records.count() == 12 and records.where("metadata.nearest_neighbor_similarity > 0").count() == 12
    met = _run(spark, out, 12, generate).collect()
    assert [(r.accepted_count, r.rejected_count) for r in met] == [(12, 0)] and len(asked) == 3
    assert tables.status(spark, f"{out}/manifest", "d").first()["accepted_count"] == 12


@pytest.mark.parametrize("sink", ["write_vectors", "append_manifest"])
def test_domain_run_repeats_a_broken_step(spark, tmp_path, monkeypatch, sink):
    """Whichever sink fails, the next run asks the same scenarios again and every id is there once."""
    asked, out = [], str(tmp_path / "run")

    def broken(*_, **__):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(tables, sink, broken)
        with pytest.raises(OSError, match="no space"):
            _run(spark, out, 4, _answers(asked), min_coverage=1)
    rows = _run(spark, out, 4, _answers(asked), min_coverage=1).collect()
    assert asked[0] == asked[1] and max(r.accepted_count for r in rows) == 4
    steps = tables.committed_steps(spark, f"{out}/manifest", "d")
    ids = [sorted(r[0] for r in x.collect()) for x in (
        tables.read_jsonl(spark, f"{out}/jsonl", steps=steps).select("id"), tables.step_examples(spark, f"{out}/examples", "d", steps).select("example_id"),
        tables.stored_vectors(spark, f"{out}/vectors", "d", steps).select("id"))]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == len(ids[0]) == 4


def test_layer1_scope(spark, tmp_path):
    """A second domain's copies of stored texts stay within a run, and go where the corpus is the scope."""
    out, tax = str(tmp_path / "run"), spark.createDataFrame([("t", "a", 0)], "dimension string, value string, ordinal int")
    go = lambda domain, scope: domain_run.run_domain(tax, domain, 3, _answers([]), _judge, out, min_coverage=1, embedder=embed.hashing_embedder(16), settings=FEW, layer1_scope=scope).agg(F.max("accepted_count")).first()[0]
    assert go("one", "run") == 3
    assert go("two", "corpus") == 1  # the fourth and last scenario asked is the only new text
    assert go("three", "run") == 3
    with pytest.raises(ValueError, match="layer1_scope"):
        go("four", "all")


def test_band_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a text that comes again and again, twice at least"), (2, "nothing like the others in the table"), (3, None)], "ord long, text string")
    path = str(tmp_path / "bands")
    for _ in range(2):  # a repeated step replaces its rows
        band_index.write_bands(band_index.text_buckets(rows.where("ord <> 2").withColumnRenamed("ord", "id"), "id", "text"), path, "s1", "r1")
    stored = band_index.read_bands(spark, path, run_id="r1")
    assert stored.count() == 14 and {r.id for r in stored.collect()} == {"1"}
    assert band_index.read_bands(spark, path, run_id="r2").count() == 0 and band_index.read_bands(spark, path, spark.createDataFrame([("s2",)], "step string")).count() == 0
    got = {r.ord: r.reason for r in dedup.deduplicate(rows, vector=None, stored_bands=stored).collect()}
    assert got == {1: "minhash", 2: None, 3: None}


def test_generate_and_judge_run_once(spark):
    """Neither is run again by the counters: both count their rows in Spark."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        n.add(1)
        return x

    kept, counters = run.curate(_generated(spark), _nodes(spark), lambda rows: _judge(rows.withColumn("prompt", seen("prompt"))))
    assert kept.count() == 5 and counters.count() == 2 and n.value == 8


def test_domain_run_without_an_accepted_example(spark, tmp_path):
    tax = spark.createDataFrame([("t", "a", 0)], "dimension string, value string, ordinal int")
    nothing = lambda requests: requests.select("node_id", F.lit("no list").alias("reply"), F.lit(1).cast("long").alias("ord"))
    rows = domain_run.run_domain(tax, "d", 3, nothing, _judge, str(tmp_path / "run")).collect()
    assert [(r.accepted_count, r.vendi_score, r.extra["asked"]) for r in sorted(rows, key=lambda r: int(r.extra["wave"]))] == [(0, None, "1"), (0, None, "2"), (0, None, "1")]


def test_observed_funnel_equals_the_pass(spark):
    """Counters that are observed while rows are written say what a pass over them says."""
    from pyspark.sql import Observation

    from sievemill.sources.storage import written

    rows = spark.range(200).select(
        "id", F.when(F.col("id") % 5 == 0, 0.0).otherwise(1.0).alias("prefilter_score"), F.expr("element_at(array('accept', 'revise', 'reject'), int(id % 3) + 1)").alias("verdict"),
        F.expr("case id % 7 when 0 then 'minhash' when 1 then 'cosine' end").alias("reason"),
    )
    for some in (rows, rows.where("id < 4"), rows.where("id < 0"), rows.where("verdict = 'revise'")):
        a, b = Observation(), Observation()
        judged = written(scoring.observe_verdicts(some.repartition(3), a), "judged")
        written(scoring.observe_reasons(scoring.accepted(scoring.passed(judged)), b), "told")
        assert sorted(map(tuple, scoring.observed_funnel(spark, a, b).collect())) == sorted(map(tuple, scoring.funnel(some).collect()))
    a, b = Observation(), Observation()
    odd = spark.createDataFrame([(1.0, None), (None, "accept"), (1.0, "perhaps")], "prefilter_score double, verdict string")
    judged = written(scoring.observe_verdicts(odd, a), "judged")
    written(scoring.observe_reasons(scoring.accepted(scoring.passed(judged)).withColumn("reason", F.lit(None).cast("string")), b), "told")
    assert sorted(map(tuple, scoring.observed_funnel(spark, a, b).collect())) == [("judge", "other", 2), ("screen", "fail", 1)]


def test_kept_counts_by_batches(spark, tmp_path):
    """Repeated batches count once, before and after a new base, and a broken base is not read."""
    path, keys = str(tmp_path / "counts"), "k string, m bigint"
    assert kept_counts.read_counts(spark, path, keys).count() == 0
    batches = [[("a", i), (None, 1), ("b", None), ("a", i)] for i in range(7)]
    want = {}
    for i, rows in enumerate(batches):
        for again in range(1 + i % 2):
            kept_counts.add_batch(spark.createDataFrame(rows, keys), keys, path, i, fold_every=3)
        for r in rows:
            want[r] = want.get(r, 0) + 1
        assert {(r.k, r.m): r.n for r in kept_counts.read_counts(spark, path, keys).collect()} == want
    for old in (0, 3):  # in a base already
        kept_counts.add_batch(spark.createDataFrame(batches[old], keys), keys, path, old, fold_every=3)
    names = sorted(p.name for p in (tmp_path / "counts").iterdir())
    assert [n for n in names if n.startswith("base")] == [f"base={2:012d}", f"base={5:012d}"] and f"batch={2:012d}" not in names
    spark.createDataFrame([("x", 1, 99)], "k string, m long, n long").write.parquet(f"{path}/base={6:012d}")
    (tmp_path / "counts" / f"base={6:012d}" / "_SUCCESS").unlink()
    kept_counts.add_batch(spark.createDataFrame([], keys), keys, path, 7, fold_every=3)
    assert {(r.k, r.m): r.n for r in kept_counts.read_counts(spark, path, keys).collect()} == want


def test_kept_coverage_of_a_stream_goes_on(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    total = None
    for i in range(3):
        more = spark.createDataFrame([({"tone": "dry", "topic": f"t{i}"},), ({"tone": "warm", "topic": None},), (None,)], "dimensions map<string,string>")
        more.coalesce(1).write.mode("append").parquet(src)
        total = more if total is None else total.unionByName(more)
        stream = continuous.file_stream(spark, src, more.schema, 1)
        kept_counts.coverage_stream(stream, out, at, fold_every=2).awaitTermination()
        kept_counts.coverage_stream(stream, out, at, fold_every=2).awaitTermination()  # nothing new
        assert sorted(map(tuple, kept_counts.kept_coverage(spark, out).collect())) == sorted(map(tuple, coverage.coverage(total).collect()))


def test_stream_progress(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    _generated(spark).coalesce(1).write.parquet(src)
    told = []
    stream = continuous.file_stream(spark, src, _generated(spark).schema, 1)
    continuous.curate_stream(stream, _nodes(spark), _judge, out, at, progress=told.append).awaitTermination()
    assert told == [{"batch": 0, "done.accepted": 5, "dedup.minhash": 3}]


def test_judge_by_tables(spark):
    examples = spark.createDataFrame([("a",), ("b",), ("c",)], "example_id string")
    screening = spark.createDataFrame([("a", True), ("b", False)], "example_id string, passed boolean")
    scores = spark.createDataFrame([("a", json.dumps(RUBRIC)), ("b", "none")], "example_id string, reply string")
    got = {r.example_id: (r.prefilter_score, r.verdict) for r in run.judge_by_tables(examples, screening, scores).collect()}
    assert got == {"a": (1.0, "accept"), "b": (0.0, "reject"), "c": (0.0, "reject")}


def test_stream(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for i in range(2):
        _generated(spark).coalesce(1).write.mode("append").parquet(src)
        stream = continuous.file_stream(spark, src, _generated(spark).schema, 1)
        continuous.curate_stream(stream, _nodes(spark), _judge, out, at).awaitTermination()
    assert spark.read.parquet(f"{out}/kept").count() == 5


def _own_replies(spark, first, n):
    rows = _answers([])(spark.createDataFrame([(f"d-{i:06d}", "p") for i in range(first, first + n)], "node_id string, prompt string"))
    return rows.coalesce(1)


def test_stream_ends_at_its_target(spark, tmp_path):
    """The batch that meets the target is cut and ends the query; later files stay unread until a higher target asks for them."""
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for i in range(4):
        _own_replies(spark, 10 * i, 4).write.mode("append").parquet(src)
    read = []

    def judge(rows):
        read.append(rows.count())
        return _judge(rows)

    def go(target, **more):
        stream = continuous.file_stream(spark, src, "node_id string, ord long, reply string", 1)
        return continuous.curate_stream(stream, _nodes(spark), judge, out, at, target, FEW, embed.hashing_embedder(16), **more)

    assert go(6).awaitTermination() and read == [4, 4]
    manifest = tables.read_manifest(spark, f"{out}/manifest").orderBy("accepted_count").collect()
    assert [(r.domain, r.target, r.accepted_count, r.rejected_count, r.extra["batch"]) for r in manifest] == [("stream", 6, 4, 0, "0"), ("stream", 6, 6, 0, "1")]
    assert go(6).awaitTermination() and read == [4, 4]
    assert go(9).awaitTermination() and read == [4, 4, 4]
    endless = go(13, once=False)  # the query waits for files, but the target ends it
    assert endless.awaitTermination(120) and not endless.query.isActive and read == [4, 4, 4, 4]
    steps = tables.committed_steps(spark, f"{out}/manifest", "stream")
    ids = [x.select(c).distinct().count() for x, c in ((tables.read_jsonl(spark, f"{out}/jsonl", steps=steps), "id"), (spark.read.parquet(f"{out}/kept"), "example_id"), (tables.stored_vectors(spark, f"{out}/vectors", None, steps), "id"))]
    assert ids == [13, 13, 13] and tables.status(spark, f"{out}/manifest", "stream").first()["accepted_count"] == 13


@pytest.mark.parametrize("sink", ["write_vectors", "append_manifest"])
def test_stream_repeats_a_broken_batch(spark, tmp_path, monkeypatch, sink):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    _own_replies(spark, 0, 4).write.parquet(src)

    def go():
        stream = continuous.file_stream(spark, src, "node_id string, ord long, reply string", 1)
        return continuous.curate_stream(stream, _nodes(spark), _judge, out, at, None, FEW, embed.hashing_embedder(16)).awaitTermination()

    def broken(*_, **__):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(tables, sink, broken)
        with pytest.raises(Exception, match="no space"):
            go()
    assert tables.read_manifest(spark, f"{out}/manifest").count() == 0
    assert go() and spark.read.parquet(f"{out}/kept").count() == 4 and spark.read.json(f"{out}/jsonl").count() == 4


def test_entry_has_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
