"""The registered queries over the given tables, and the SQL that any engine answers them with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import DEFAULTS, GENERIC_TAXONOMY, RUBRIC_WEIGHTS, Settings
from ..functions import replies, shingles
from ..operators import coverage, dedup, diversity, neighbours, requests, sampling, scoring, similarity, spectrum
from ..sources import band_index, tables, taxonomy
from ..sources.storage import shared_folder
from ..streaming import continuous, kept_counts
from . import curate as run
from . import domain_run

# Fixed factors by which fixtures derive five rubric scores from a number.
FACTORS = dict(zip(RUBRIC_WEIGHTS, ((7, 3), (3, 4), (11, 2), (13, 4), (17, 1)), strict=True))


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _glob(d: str, name: str) -> str:
    """A pattern for a table that is a file or a folder: a stream's plain path has to be a folder."""
    return f"{d}/{name}.parque[t]"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = _read(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    c = c.where("role = 'user' and next_role = 'assistant'")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"), "conv_id", "turn", F.col("text").alias("prompt"), F.col("next_text").alias("completion"))


PAIRS = """pairs AS (
  SELECT conv_id || '-' || turn AS example_id, conv_id, turn, text AS prompt, next_text AS completion FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def _rubric(number: str):
    return F.create_map(*[x for k, (a, b) in FACTORS.items() for x in (F.lit(k), (F.pmod(F.col(number) * a + b, F.lit(5)) + 1).cast("int"))])


_HUNDREDTHS = " + ".join(f"{w} * (({{n}} * {a} + {b}) % 5 + 1)" for (_, w), (a, b) in zip(RUBRIC_WEIGHTS.items(), FACTORS.values(), strict=True))
_VERDICT = "CASE WHEN h >= 350 THEN 'accept' WHEN h BETWEEN 300 AND 340 THEN 'revise' ELSE 'reject' END"


def rubric_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, scored and judged: the flagship."""
    rows = pairs(spark, d).withColumn("n", F.length("prompt") + F.length("completion")).withColumn("rubric", _rubric("n"))
    return scoring.judged(rows).select("example_id", F.round("composite_score", 2).alias("composite_score"), "verdict")


def verdict_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").withColumn("rubric", _rubric("doc_id"))
    kept = scoring.accepted(scoring.judged(rows)).withColumn("dimensions", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return coverage.coverage(kept)


def taxonomy_values(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.from_columns(_read(spark, d, "documents"), "documents", ["lang", "source"])


def _doc_dimensions(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return _read(spark, d, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("size"), size).alias("dimensions"))


def coverage_all(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage(_doc_dimensions(spark, d))


_COVERAGE = """c AS (SELECT dimension, value, count(*) AS n FROM (
  SELECT 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents
  UNION ALL SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END FROM documents)
  WHERE value IS NOT NULL GROUP BY 1, 2)"""


def coverage_json(spark: SparkSession, d: str) -> DataFrame:
    return coverage.json_coverage(_read(spark, d, "events"), "props", "k")


def _expected(spark: SparkSession, d: str) -> int:
    return _read(spark, d, "documents").count() // 4


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return coverage.gaps(coverage_all(spark, d), _expected(spark, d))


def coverage_gaps_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of nations among suppliers, twice the mean expected; nations without a supplier count in full."""
    suppliers, nations = _read(spark, d, "supplier"), _read(spark, d, "nation")
    dims = suppliers.select(F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("dimensions"))
    known = taxonomy.from_columns(nations.select(F.col("n_nationkey").alias("nation")), "suppliers", ["nation"])
    return coverage.gaps(coverage.coverage(dims), 2 * suppliers.count() // 25 + 1, known)


def deficit_total(spark: SparkSession, d: str) -> DataFrame:
    return coverage.total_deficit(coverage_gaps(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    tax = taxonomy.from_columns(_read(spark, d, "orders"), "orders", ["o_orderpriority", "o_orderstatus"])
    return sampling.sample_node_sets(tax, "orders", _read(spark, d, "documents").count(), min_coverage=3, seed=7)


def node_sets(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("idx", "node_id", F.col("dimensions")["o_orderpriority"].alias("priority"), F.col("dimensions")["o_orderstatus"].alias("status"))


def node_set_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every value with whether it is covered: all are, by construction."""
    return coverage.coverage(_nodes(spark, d)).select("dimension", "value", (F.col("n") >= 3).alias("covered"))


def infeasible_dimensions(spark: SparkSession, d: str) -> DataFrame:
    tax = taxonomy.from_columns(_read(spark, d, "documents"), "documents", ["lang", "source"])
    return sampling.infeasible(tax, 40, 3)


def request_generation(spark: SparkSession, d: str) -> DataFrame:
    return requests.generation_requests(_nodes(spark, d)).select("request_id", "role", "temperature", "max_tokens", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


def _batched(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("part", F.floor(F.col("conv_id") / 100))
    return requests.screening_batches(rows, "part", ["conv_id", "turn"])


def request_screening(spark: SparkSession, d: str) -> DataFrame:
    rows = requests.screening_requests(_batched(spark, d), "part")
    return rows.select("request_id", (F.length("prompt") - F.length(F.replace("prompt", F.lit("\n")))).alias("line_breaks"), F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


def request_scoring(spark: SparkSession, d: str) -> DataFrame:
    rows = requests.scoring_requests(pairs(spark, d))
    return rows.select("request_id", "max_tokens", F.substring_index("prompt", "\n\nInstruction:\n", -1).alias("tail"))


def _reply(rows: DataFrame) -> DataFrame:
    """Generator replies by the number of the conversation: clean, fenced, with chatter, and as another pair of keys."""
    item = lambda a, b: F.concat(F.lit(f'[{{"{a}": '), requests.json_text("prompt"), F.lit(f', "{b}": '), requests.json_text("completion"), F.lit("}, 3, \"x\"]"))
    clean, other = item("instruction", "response"), item("prompt", "completion")
    kind = F.pmod("conv_id", F.lit(4))
    text = F.when(kind == 0, clean).when(kind == 1, F.concat(F.lit("```json\n"), other, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure, here: "), clean, F.lit(" Done."))).otherwise(other)
    body = F.concat(F.lit('{"choices": [{"message": {"content": '), requests.json_text(text), F.lit("}}]}"))
    return rows.withColumn("body", body).withColumn("reply", replies.envelope_content("body"))


def reply_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = _reply(pairs(spark, d).withColumnRenamed("example_id", "node_id"))
    return replies.parse_examples(rows).select("node_id", "prompt", "completion")


def screen_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents screened by replies made from their labels; a document without a label has no verdict and fails."""
    docs = _read(spark, d, "documents").select("doc_id").join(_read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    rows = docs.withColumn("batch", F.expr("doc_id div 3")).withColumn("pos", F.pmod("doc_id", F.lit(3)).cast("int"))
    item = F.concat(F.lit('{"id": "'), F.col("pos").cast("string"), F.lit('", "pass": '), F.col("quality").cast("string"), F.lit("}"))
    told = rows.groupBy("batch").agg(F.concat(F.lit("[{\"id\": 0, \"pass\": \"maybe\"}, "), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("]")).alias("reply"), F.lit(3).alias("size"))
    told = told.withColumn("reply", F.regexp_replace("reply", r", \]$", "]"))
    verdicts = replies.parse_verdicts(told, "reply", ["batch"], "size")
    return scoring.screened(rows, verdicts, ["batch"]).select("doc_id", "prefilter_score")


def _rubric_reply(rows: DataFrame) -> DataFrame:
    """Scorer replies by the number of the document: clean, fenced, a draft before, a block after, garbage."""
    body = F.to_json(_rubric("doc_id"))
    draft = F.lit('{"factuality": 1}')
    kind = F.pmod("doc_id", F.lit(5))
    text = (
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(draft, F.lit(" then "), body))
        .when(kind == 3, F.concat(F.lit("x "), body, F.lit(' {"note": {"a": 1}}'))).otherwise("no scores {")
    )
    return rows.withColumn("reply", text)


def rubric_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _rubric_reply(_read(spark, d, "documents").select("doc_id")).withColumn("rubric", replies.parse_rubric("reply"))
    rows = scoring.judged(rows)
    return rows.select("doc_id", F.size("rubric").alias("dimensions"), F.round("composite_score", 2).alias("composite_score"), "verdict")


def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = screen_verdicts(spark, d).withColumn("rubric", _rubric("doc_id"))
    return scoring.funnel(scoring.judged(rows))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.size(shingles.ngrams("text")).cast("long").alias("n"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer parts than the cluster has cores, dealt to all of them; a table of many parts isn't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "doc_id") if rows.rdd.getNumPartitions() < cores else rows


def _signed(spark: SparkSession, d: str) -> DataFrame:
    docs = _spread(_read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", shingles.text_signature("text").alias("minhash"))


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("doc_id", F.array_join(F.col("minhash").cast("array<string>"), ",").alias("signature"))


def lsh_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of two or more documents: how many, and the first."""
    b = similarity.lsh_buckets(_signed(spark, d), "doc_id")
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links between distinct texts; each text stands by its smallest id."""
    rows = similarity.jaccard_links(_spread(_read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return rows.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def dedup_text(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    return dedup.deduplicate(docs, vector=None).select("ord", "reason")


def dedup_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents in two batches of about one size, the second against the band index of the first: as if all came in one."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    middle = docs.agg(F.avg("ord")).first()[0] or 0
    path = _scratch(spark, "bands")
    first = dedup.deduplicate(docs.where(F.col("ord") < middle), vector=None)
    kept = first.where("reason is null").withColumnRenamed("ord", "id")
    band_index.write_bands(band_index.text_buckets(kept, "id", "text"), path, "first")
    second = dedup.deduplicate(docs.where(F.col("ord") >= middle), vector=None, stored_bands=band_index.read_bands(spark, path))
    return first.unionByName(second).select("ord", "reason")


def dedup_two_layers(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the vector of the same number, where there is one."""
    v = _read(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text").join(v, "ord", "left")
    return dedup.deduplicate(docs, metric="cosine").select("ord", "reason")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("domain"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.nearest_similarity(_vectors(spark, d), _vectors(spark, d))
    return rows.select("id", F.round("similarity", 6).alias("similarity"))


def nearest_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of each vector through an index of all, written in two steps: exact, by the cells' radii."""
    path, v = _scratch(spark, "index"), _vectors(spark, d)
    neighbours.write_index(v.where("id % 2 = 0"), path, "even")
    neighbours.write_index(v.where("id % 2 <> 0"), path, "odd")
    rows = neighbours.nearest(v.withColumn("id", F.col("id").cast("string")), neighbours.read_index(spark, path), exact=True)
    return rows.select(F.col("id").cast("long").alias("id"), F.round("similarity", 6).alias("similarity"))


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.similar_vectors(_vectors(spark, d), _vectors(spark, d), "cosine", 0.4, half=True)
    return rows.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.checked_vectors(_vectors(spark, d), 64).groupBy("domain").agg(F.count("*").alias("n"))


def gram(spark: SparkSession, d: str) -> DataFrame:
    rows = diversity.gram_matrix(_vectors(spark, d)).withColumn("g", F.round("g", 6))
    return rows.select("domain", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.col("g") + 0.0).alias("g"))


def vendi_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the labels from sketches of 32 rows; vectors have 64 components."""
    return spectrum.vendi(_vectors(spark, d), size=32).select("domain", "n", *[F.round(c, 6).alias(c) for c in ("score", "low", "high", "error")])


def vendi_by_label(spark: SparkSession, d: str) -> DataFrame:
    return diversity.vendi(_vectors(spark, d)).select("domain", "n", F.round("score", 6).alias("score"))


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("n", F.length("prompt") + F.length("completion")).withColumn("rubric", _rubric("n"))
    rows = scoring.accepted(scoring.judged(rows)).withColumn("node_id", F.concat(F.lit("orders-"), F.lpad(F.col("conv_id").cast("string"), 6, "0")))
    return run.hydrate(rows.withColumn("created_at", F.timestamp_seconds("conv_id")), _nodes(spark, d))


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d).select("example_id", F.col("taxonomy_node")["domain"].alias("domain"), F.col("taxonomy_node")["node_id"].alias("node"), F.col("taxonomy_node")["o_orderstatus"].alias("status"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "jsonl")
    tables.write_jsonl(_accepted(spark, d), path)
    rows = tables.read_jsonl(spark, path)
    return rows.select("id", "instruction", "response", "reasoning_trace", F.round("metadata.composite_score", 2).alias("score"), F.col("metadata.timestamp").alias("at"))


def example_table(spark: SparkSession, d: str) -> DataFrame:
    """Examples written twice: ids that are stored already aren't written again."""
    path = _scratch(spark, "examples")
    tables.write_examples(_accepted(spark, d), path)
    tables.write_examples(_accepted(spark, d), path)
    return spark.read.parquet(path).groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("example_id").alias("ids"))


def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").select(
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"),
        F.col("o_orderkey").cast("long").alias("accepted_count"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )
    path = _scratch(spark, "manifest")
    tables.append_manifest(rows, path)
    return tables.latest_manifest(tables.read_manifest(spark, path)).select("domain", "run_id", "accepted_count")


def run_ids(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select("s_suppkey", tables.run_id("s_name", F.timestamp_seconds(F.col("s_suppkey").cast("long"))).alias("run_id"), taxonomy.slug("s_name").alias("slug"))


def target_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred accepted documents in order: the feature is the limit."""
    rows = scoring.accepted(scoring.judged(_read(spark, d, "documents").withColumn("rubric", _rubric("doc_id"))))
    return run.first_accepted(rows, 100, "doc_id").select("doc_id", F.round("composite_score", 2).alias("composite_score"))


def resume_rest(spark: SparkSession, d: str) -> DataFrame:
    done = _accepted(spark, d).select("node_id")
    return run.unprocessed(_nodes(spark, d), done).select("node_id")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    name = f"counts_{uuid.uuid4().hex}"
    events = continuous.file_stream(spark, _glob(d, "events"), _read(spark, d, "events").schema)
    continuous.running_counts(events, ["event_type"], name).awaitTermination()
    return spark.table(name)


def stream_coverage(spark: SparkSession, d: str) -> DataFrame:
    name = f"coverage_{uuid.uuid4().hex}"
    docs = continuous.file_stream(spark, _glob(d, "documents"), _read(spark, d, "documents").schema)
    docs = docs.select(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("dimensions"))
    continuous.running_coverage(docs, name).awaitTermination()
    return spark.table(name)


def stream_kept_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and user, kept as a table by batches."""
    out = _scratch(spark, "kept_counts")
    events = continuous.file_stream(spark, _glob(d, "events"), _read(spark, d, "events").schema)
    kept_counts.count_stream(events, "event_type string, user_id bigint", out, f"{out}_at").awaitTermination()
    return kept_counts.read_counts(spark, out, "event_type string, user_id bigint")


def stream_kept_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the coverage that a stream keeps, against twice the mean of the values."""
    out = _scratch(spark, "kept_coverage")
    docs = continuous.file_stream(spark, _glob(d, "documents"), _read(spark, d, "documents").schema)
    docs = docs.select(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("dimensions"))
    kept_counts.coverage_stream(docs, out, f"{out}_at").awaitTermination()
    kept = kept_counts.kept_coverage(spark, out)
    mean = kept.agg(F.expr("coalesce(sum(n) div count(*), 0)")).first()[0]
    return coverage.gaps(kept, int(2 * mean))


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Users in the order of their first event's file: one row each."""
    out, at = _scratch(spark, "seen"), _scratch(spark, "seen-checkpoint")
    events = continuous.file_stream(spark, _glob(d, "events"), _read(spark, d, "events").schema)
    seen = continuous.first_seen(events.select("user_id"), "user_id")
    seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long").parquet(out)


def curated(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over replies made from conversations, judged by their length."""
    rows = pairs(spark, d).withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    rows = _reply(rows.withColumn("node_id", F.concat(F.lit("orders-"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))))

    def judge(examples: DataFrame) -> DataFrame:
        examples = examples.withColumn("prefilter_score", F.lit(1.0)).withColumn("n", F.length("prompt") + F.length("completion"))
        return scoring.judged(examples.withColumn("rubric", _rubric("n"))).drop("n")

    kept, _ = run.curate(rows.select("node_id", "ord", "reply"), _nodes(spark, d), judge)
    return kept.select("example_id", "node_id", "composite_score", F.col("taxonomy_node")["domain"].alias("domain"))


def taxonomy_files(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy file made from the documents' languages and sources, read back and checked."""
    values = taxonomy_values(spark, d).groupBy("dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("values"))
    text = values.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "values"))))).alias("value"))
    path = _scratch(spark, "taxonomy")
    tables.write_text(text, f"{path}/documents.json")
    return taxonomy.load_taxonomy(spark, path, "documents")


def taxonomy_domains(spark: SparkSession, d: str) -> DataFrame:
    """One taxonomy file for each language."""
    path = _scratch(spark, "taxonomy")
    for r in _read(spark, d, "documents").where("lang is not null").select("lang").distinct().collect():  # a handful of languages
        tables.write_text(spark.createDataFrame([(f'{{"lang": ["{r.lang}"]}}',)], "value string"), f"{path}/{r.lang}.json")
    return taxonomy.list_domains(spark, path)


def taxonomy_violations(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy text for each document, of a kind by its number: right, a value twice, no object, an empty list, an empty value, a number, no dimension."""
    lang = requests.json_text("lang")
    kinds = [("[", lang, "]"), ("[", lang, ", ", lang, "]"), None, ("[]",), ('["", "a"]',), ('["a", 3]',)]
    text, kind = F.lit("{}"), F.pmod("doc_id", F.lit(7))
    for n, parts in enumerate(kinds):
        whole = F.lit("[1]") if parts is None else F.concat(F.lit('{"lang": '), *[x if not isinstance(x, str) else F.lit(x) for x in parts], F.lit("}"))
        text = F.when(kind == n, whole).otherwise(text)
    return taxonomy.violations(_read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("domain"), text.alias("doc")))


def generic_nodes(spark: SparkSession, d: str) -> DataFrame:
    """As many node sets of the built-in taxonomy as there are documents: each value at least three times."""
    nodes = sampling.sample_node_sets(taxonomy.generic_taxonomy(spark, "brief"), "brief", _read(spark, d, "documents").count(), 3, 11, use_case="a brief")
    return coverage.coverage(nodes).select("dimension", "value", (F.col("n") >= 3).alias("covered"))


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written by domain; those of one domain read back."""
    path = _scratch(spark, "vectors")
    tables.write_vectors(_vectors(spark, d).withColumn("composite_score", F.lit(4.0)), path, 64)
    first = _vectors(spark, d).agg(F.min("domain")).first()[0]
    rows = tables.stored_vectors(spark, path, first)
    return rows.select("id", F.lit(first).alias("domain"), F.size("vector").alias("width"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


def screen_passed(spark: SparkSession, d: str) -> DataFrame:
    return scoring.passed(screen_verdicts(spark, d)).select("doc_id")


def example_count(spark: SparkSession, d: str) -> DataFrame:
    """Accepted examples in all and in a domain."""
    rows = _accepted(spark, d).withColumn("domain", F.col("taxonomy_node")["domain"])
    count = lambda name, of: coverage.count(rows, of).select(F.lit(name).alias("which"), "n")
    return count("all", None).unionByName(count("orders", "orders"))


def stream_screened(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a stream screened in batches; the replies pass every number that three doesn't divide."""
    out, at = _scratch(spark, "screened"), _scratch(spark, "screened-checkpoint")
    docs = continuous.file_stream(spark, _glob(d, "documents"), _read(spark, d, "documents").schema)
    docs = docs.select("doc_id", F.expr("doc_id div 100").alias("part"), F.col("doc_id").cast("string").alias("prompt"), F.coalesce("text", F.lit("")).alias("completion"))

    def answer(asked: DataFrame) -> DataFrame:
        found = F.arrays_zip(*[F.regexp_extract_all("prompt", F.lit(r'\{"id": (\d+), "instruction": "(\d+)", "response"'), F.lit(g)).alias(f"g{g}") for g in (1, 2)])
        item = F.transform(found, lambda x: F.concat(F.lit('{"id": '), x["g1"], F.lit(', "pass": '), F.when(x["g2"].cast("long") % 3 == 0, "false").otherwise("true"), F.lit("}")))
        return asked.select("request_id", F.concat(F.lit("["), F.array_join(item, ", "), F.lit("]")).alias("reply"))

    continuous.screen_stream(docs, answer, "part", ["doc_id"], out, at).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "batch", "pos", "prefilter_score")


def _conversation_run(spark: SparkSession, d: str, target: int, settings: Settings) -> DataFrame:
    """A run from sampling to manifest: a request is answered by the conversation of its number, scores come from lengths."""
    told = _reply(pairs(spark, d).withColumn("node_id", F.concat(F.lit("orders-"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))))

    def generate(asked: DataFrame) -> DataFrame:
        return told.join(asked.select("node_id"), "node_id", "left_semi").select("node_id", "reply", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))

    def judge(examples: DataFrame) -> DataFrame:
        examples = examples.withColumn("prefilter_score", F.lit(1.0)).withColumn("n", F.length("prompt") + F.length("completion"))
        return scoring.judged(examples.withColumn("rubric", _rubric("n"))).drop("n")

    tax = taxonomy.from_columns(_read(spark, d, "orders"), "orders", ["o_orderpriority", "o_orderstatus"])
    return domain_run.run_domain(tax, "orders", target, generate, judge, _scratch(spark, "run"), seed=7, settings=settings)


def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint at every ten accepted."""
    rows = _conversation_run(spark, d, pairs(spark, d).count(), Settings(checkpoint_every=10))
    return rows.select("domain", "target", "accepted_count", "rejected_count", F.round("vendi_score", 6).alias("vendi_score"), F.to_json("taxonomy_coverage").alias("coverage"))


def run_waves(spark: SparkSession, d: str) -> DataFrame:
    """The waves of a run to half as many examples as there are conversations, without near-duplicate removal: each as large as the acceptance before it demands."""
    target = _read(spark, d, "conversations").select("conv_id").distinct().count() // 2
    rows = _conversation_run(spark, d, target, Settings(checkpoint_every=1 << 40, bands=0))
    extra = lambda k: F.col("extra")[k].cast("long").alias(k)
    return rows.select(extra("wave"), extra("asked"), extra("asked_to"), "accepted_count", "rejected_count", F.aggregate(F.map_values("taxonomy_coverage"), F.lit(0).cast("long"), lambda a, x: a + x).alias("covered"))


QUERIES = {
    f.__name__: f
    for f in (
        rubric_pipeline, verdict_coverage, taxonomy_values, coverage_all, coverage_json, coverage_gaps, coverage_gaps_unseen, deficit_total,
        node_sets, node_set_coverage, infeasible_dimensions, request_generation, request_screening, request_scoring, reply_examples,
        screen_verdicts, rubric_parse, stage_funnel, ngram_counts, minhash_signatures, lsh_collisions, jaccard_pairs, dedup_text, dedup_two_batches, dedup_two_layers,
        nearest, nearest_indexed, similar_pairs, domain_counts, gram, vendi_by_label, vendi_sketched, hydrated, jsonl_round_trip, example_table, manifest_latest, run_ids,
        target_limit, resume_rest, stream_counts, stream_coverage, stream_kept_counts, stream_kept_gaps, stream_first_seen, curated,
        taxonomy_files, taxonomy_domains, taxonomy_violations, generic_nodes, vector_table, screen_passed, example_count, stream_screened, run_manifest, run_waves,
    )
} | {"instruction_pairs": lambda spark, d: pairs(spark, d).select("example_id", "prompt", "completion")}


def _md5(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


_TAX = """tax AS (SELECT dimension, value, CAST(row_number() OVER (PARTITION BY dimension ORDER BY value) - 1 AS INTEGER) AS ordinal FROM (
  SELECT DISTINCT 'o_orderpriority' AS dimension, o_orderpriority AS value FROM orders UNION SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders) WHERE value IS NOT NULL)"""
_ROUND = lambda j, v: _md5("'7'", "dimension", "i // k", f"'{j}'", v)
_SAMPLE = f"""{_TAX},
grid AS (SELECT dimension, count(*) AS k, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a, CAST(ceil(count(*) / ceil(sqrt(count(*)))) AS BIGINT) AS b FROM tax GROUP BY 1),
walk(dimension, k, a, b, i, x, step) AS (
  SELECT dimension, k, a, b, i, i % k, 0 FROM grid, (SELECT range AS i FROM range((SELECT count(*) FROM documents))) UNION ALL
  SELECT dimension, k, a, b, i, l2 * b + (r1 + {_ROUND(4, "l2")}) % b, step + 1 FROM (SELECT *, (l1 + {_ROUND(3, "r1")}) % a AS l2 FROM (
    SELECT *, (r0 + {_ROUND(2, "l1")}) % b AS r1 FROM (SELECT *, (l0 + {_ROUND(1, "r0")}) % a AS l1 FROM (SELECT *, x // b AS l0, x % b AS r0 FROM walk WHERE step = 0 OR x >= k))))),
picks AS (SELECT i, dimension, value FROM walk JOIN tax USING (dimension) WHERE step > 0 AND x < k AND ordinal = x),
nodes AS (SELECT i AS idx, 'orders-' || lpad(CAST(i AS VARCHAR), 6, '0') AS node_id,
    max(value) FILTER (dimension = 'o_orderpriority') AS priority, max(value) FILTER (dimension = 'o_orderstatus') AS status FROM picks GROUP BY i)"""
_GRAMS = """g AS (SELECT doc_id, CASE WHEN len(c) = 0 THEN [] WHEN len(c) <= 5 THEN [array_to_string(c, '')]
    ELSE list_distinct([c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4] FOR i IN range(1, len(c) - 3)]) END AS g
  FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(lower(text), '') END AS c FROM documents))"""
_A, _B = shingles.coefficients(DEFAULTS.permutations)
_SIGNED = f"""{_GRAMS}, h AS (SELECT doc_id, [CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) FOR x IN g] AS h FROM g WHERE len(g) > 0),
perm AS (SELECT unnest({_A}) AS a, unnest({_B}) AS b, unnest(range({DEFAULTS.permutations})) AS p),
s AS (SELECT doc_id, list(m ORDER BY p) AS s FROM (SELECT doc_id, p, list_min([(a * x + b) % {shingles.PRIME} FOR x IN h]) AS m FROM h CROSS JOIN perm) GROUP BY doc_id)"""
# Going through the rows that an earlier one collides with: a row goes if one that stays collides with it.
_BUCKETS = f"{_SIGNED}, b AS MATERIALIZED (SELECT doc_id, i || '_' || array_to_string(s[i * 9 + 1 : i * 9 + 9], '_') AS bucket FROM s CROSS JOIN (SELECT unnest(range(14)) AS i))"
_HASHED = "SELECT y.doc_id AS y, x.doc_id AS x, true AS lsh FROM b x JOIN b y ON x.bucket = y.bucket AND x.doc_id < y.doc_id"
_COSINE = """SELECT q.vec_id, p.vec_id, false FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.92"""


def _first_wins_sql(more: str = "", links: str = "") -> str:
    return f"""WITH RECURSIVE {_BUCKETS}{more}, l AS MATERIALIZED ({_HASHED}{links}),
        n AS MATERIALIZED (SELECT y, list(DISTINCT x) AS xs, row_number() OVER (ORDER BY y) AS step FROM l GROUP BY y),
        w AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone UNION ALL
          SELECT n.step, CASE WHEN len(list_filter(xs, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, y) ELSE gone END FROM w JOIN n ON n.step = w.step + 1),
        z AS MATERIALIZED (SELECT DISTINCT unnest(gone) AS y FROM (SELECT gone FROM w ORDER BY step DESC LIMIT 1)),
        r AS (SELECT z.y, bool_or(lsh) AS lsh FROM z JOIN l USING (y) WHERE x NOT IN (SELECT y FROM z) GROUP BY 1)
        SELECT doc_id AS ord, CASE WHEN r.y IS NULL THEN NULL WHEN lsh THEN 'minhash' ELSE 'cosine' END AS reason FROM documents LEFT JOIN r ON r.y = doc_id"""


_JUDGED = f"j AS (SELECT *, {_VERDICT} AS verdict FROM (SELECT *, {_HUNDREDTHS.format(n='doc_id')} AS h FROM documents))"
_GOOD = f"ok AS (SELECT * FROM (SELECT *, {_VERDICT} AS verdict FROM (SELECT *, {_HUNDREDTHS.format(n='(length(prompt) + length(completion))')} AS h FROM pairs)) WHERE verdict = 'accept')"
_SCREEN = "q AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 1.0 ELSE 0.0 END AS s FROM labels GROUP BY doc_id)"

ORACLES = {
    "instruction_pairs": f"WITH {PAIRS} SELECT example_id, prompt, completion FROM pairs",
    "rubric_pipeline": f"""WITH {PAIRS} SELECT example_id, round(h / 100.0, 2)::DOUBLE AS composite_score, {_VERDICT} AS verdict
        FROM (SELECT *, {_HUNDREDTHS.format(n='(length(prompt) + length(completion))')} AS h FROM pairs)""",
    "verdict_coverage": f"""WITH {_JUDGED} SELECT dimension, value, count(*) AS n FROM (SELECT 'lang' AS dimension, lang AS value FROM j WHERE verdict = 'accept'
        UNION ALL SELECT 'source', source FROM j WHERE verdict = 'accept') WHERE value IS NOT NULL GROUP BY 1, 2""",
    "taxonomy_values": """SELECT 'documents' AS domain, dimension, value, CAST(row_number() OVER (PARTITION BY dimension ORDER BY value) - 1 AS INTEGER) AS ordinal FROM (
        SELECT 'lang' AS dimension, lang AS value FROM documents UNION SELECT 'source', source FROM documents) WHERE value IS NOT NULL""",
    "coverage_all": f"WITH {_COVERAGE} SELECT * FROM c",
    "coverage_json": "SELECT trim(json_extract_string(props, '$.k'), '\"') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1",
    "coverage_gaps": f"WITH {_COVERAGE} SELECT dimension, value, (SELECT count(*) // 4 FROM documents) - n AS deficit FROM c WHERE (SELECT count(*) // 4 FROM documents) > n",
    "coverage_gaps_unseen": """WITH c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), e AS (SELECT 2 * count(*) // 25 + 1 AS e FROM supplier)
        SELECT 'nation' AS dimension, CAST(n_nationkey AS VARCHAR) AS value, e - coalesce(n, 0) AS deficit FROM nation LEFT JOIN c ON k = n_nationkey, e WHERE e > coalesce(n, 0)""",
    "deficit_total": f"WITH {_COVERAGE} SELECT CAST(coalesce(sum(t - n), 0) AS BIGINT) AS deficit FROM (SELECT n, (SELECT count(*) // 4 FROM documents) AS t FROM c) WHERE t > n",
    "node_sets": f"WITH {_SAMPLE} SELECT idx, node_id, priority, status FROM nodes",
    "node_set_coverage": f"WITH {_TAX} SELECT dimension, value, true AS covered FROM tax",
    "infeasible_dimensions": """SELECT dimension, count(*) * 3 AS needed FROM (SELECT 'lang' AS dimension, lang AS value FROM documents UNION SELECT 'source', source FROM documents)
        WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) * 3 > 40""",
    "request_generation": f"""WITH {_SAMPLE} SELECT request_id, role, temperature, max_tokens, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5 FROM (
        SELECT node_id AS request_id, 'generator' AS role, 0.9::DOUBLE AS temperature, 4096 AS max_tokens, 'Write 10 different training examples for the domain "orders".' || chr(10) || 'Scenario: {{"o_orderpriority": "' || priority || '", "o_orderstatus": "' || status || '"}}' || chr(10)
        || 'Answer with a JSON array of objects with the keys instruction and response.' AS p FROM nodes)""",
    "request_screening": f"""WITH {PAIRS}, n AS (SELECT *, conv_id // 100 AS part, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id, turn) - 1 AS r FROM pairs),
        l AS (SELECT part, r // 3 AS batch, string_agg('{{"id": ' || (r % 3) || ', "instruction": ' || CAST(to_json(prompt) AS VARCHAR) || ', "response": ' || CAST(to_json(completion) AS VARCHAR) || '}}', chr(10) ORDER BY r) AS t FROM n GROUP BY 1, 2),
        p AS (SELECT 'screen-' || part || '-' || batch AS request_id, 'Decide for each line whether the example is usable.' || chr(10) || t || chr(10) || 'Answer with a JSON array of {{"id": int, "pass": bool}}.' AS p FROM l)
        SELECT request_id, CAST(length(p) - length(replace(p, chr(10), '')) AS INTEGER) AS line_breaks, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5 FROM p""",
    "request_scoring": f"WITH {PAIRS} SELECT example_id AS request_id, 2048 AS max_tokens, prompt || chr(10) || chr(10) || 'Response:' || chr(10) || completion AS tail FROM pairs",
    "reply_examples": f"WITH {PAIRS} SELECT example_id AS node_id, prompt, completion FROM pairs WHERE prompt <> '' AND completion <> ''",
    "screen_verdicts": f"WITH {_SCREEN} SELECT doc_id, coalesce(s, 0.0)::DOUBLE AS prefilter_score FROM documents LEFT JOIN q USING (doc_id)",
    "rubric_parse": f"""WITH {_JUDGED} SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 5 END AS dimensions, CASE WHEN doc_id % 5 = 4 THEN 0.0 ELSE round(h / 100.0, 2) END::DOUBLE AS composite_score,
        CASE WHEN doc_id % 5 = 4 THEN 'reject' ELSE verdict END AS verdict FROM j""",
    "stage_funnel": f"""WITH {_SCREEN}, {_JUDGED} SELECT CASE WHEN coalesce(s, 0) < 1 THEN 'screen' WHEN verdict <> 'accept' THEN 'judge' ELSE 'done' END AS stage,
        CASE WHEN coalesce(s, 0) < 1 THEN 'fail' WHEN verdict <> 'accept' THEN verdict ELSE 'accepted' END AS outcome, count(*) AS n FROM j LEFT JOIN q USING (doc_id) GROUP BY 1, 2""",
    "ngram_counts": f"WITH {_GRAMS} SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g",
    "minhash_signatures": f"WITH {_SIGNED} SELECT g.doc_id, array_to_string(s, ',') AS signature FROM g LEFT JOIN s USING (doc_id)",
    "lsh_collisions": f"""WITH {_SIGNED}, b AS (SELECT doc_id, i || '_' || array_to_string(s[i * 9 + 1 : i * 9 + 9], '_') AS bucket FROM s CROSS JOIN (SELECT unnest(range(14)) AS i))
        SELECT bucket, count(*) AS n, min(doc_id) AS first_doc FROM b GROUP BY bucket HAVING count(*) > 1""",
    "nearest": """WITH v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)
        SELECT a.id, round(max(1 / (1 + greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 0))), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id""",
    "similar_pairs": """WITH v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)
        SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4""",
    "domain_counts": "SELECT CAST(label AS VARCHAR) AS domain, count(*) AS n FROM embeddings GROUP BY 1",
    "gram": """WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS domain, [CAST(x AS DOUBLE) / sqrt(list_dot_product([CAST(y AS DOUBLE) FOR y IN embedding], [CAST(y AS DOUBLE) FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings),
        e AS (SELECT vec_id, domain, unnest(v) AS x, unnest(range(len(v))) AS i FROM v)
        SELECT a.domain, a.i, b.i AS j, round(sum(a.x * b.x), 6) + 0.0 AS g FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2, 3""",
    "hydrated": f"""WITH {PAIRS}, {_GOOD}, {_SAMPLE} SELECT example_id, CASE WHEN n.node_id IS NULL THEN '' ELSE 'orders' END AS domain, k AS node, status
        FROM (SELECT *, 'orders-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS k FROM ok) LEFT JOIN nodes n ON n.node_id = k""",
    "jsonl_round_trip": f"""WITH {PAIRS}, {_GOOD} SELECT example_id AS id, prompt AS instruction, completion AS response, CAST(NULL AS VARCHAR) AS reasoning_trace, round(h / 100.0, 2)::DOUBLE AS score,
        strftime(make_timestamp(conv_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM ok""",
    "example_table": f"""WITH {PAIRS}, {_GOOD}, {_SAMPLE} SELECT CASE WHEN n.node_id IS NULL THEN NULL ELSE 'orders' END AS domain, count(*) AS n, count(DISTINCT example_id) AS ids
        FROM (SELECT *, 'orders-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS k FROM ok) LEFT JOIN nodes n ON n.node_id = k GROUP BY 1""",
    "manifest_latest": """SELECT 'c' || o_custkey AS domain, arg_max('run_' || o_orderkey, {'t': o_orderdate, 'k': o_orderkey}) AS run_id, arg_max(o_orderkey, {'t': o_orderdate, 'k': o_orderkey}) AS accepted_count
        FROM orders GROUP BY o_custkey""",
    "run_ids": """SELECT s_suppkey, 'run_' || strftime(make_timestamp(s_suppkey * 1000000), '%Y%m%d_%H%M%S') || '_' || regexp_replace(s_name, '[^A-Za-z0-9_-]', '_', 'g') AS run_id,
        substr(trim(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) AS slug FROM supplier""",
    "target_limit": f"WITH {_JUDGED} SELECT doc_id, round(h / 100.0, 2)::DOUBLE AS composite_score FROM j WHERE verdict = 'accept' ORDER BY doc_id LIMIT 100",
    "resume_rest": f"WITH {PAIRS}, {_GOOD}, {_SAMPLE} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT 'orders-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') FROM ok)",
    "taxonomy_files": """SELECT 'documents' AS domain, dimension, value, CAST(row_number() OVER (PARTITION BY dimension ORDER BY value) - 1 AS INTEGER) AS ordinal FROM (
        SELECT 'lang' AS dimension, lang AS value FROM documents UNION SELECT 'source', source FROM documents) WHERE value IS NOT NULL""",
    "taxonomy_domains": "SELECT DISTINCT lang AS domain FROM documents WHERE lang IS NOT NULL",
    "taxonomy_violations": """SELECT 'd' || doc_id AS domain, CASE WHEN doc_id % 7 IN (2, 6) THEN NULL ELSE 'lang' END AS dimension,
        CASE doc_id % 7 WHEN 1 THEN CASE WHEN coalesce(lang, '') = '' THEN 'empty value' ELSE 'duplicate value ' || lang END WHEN 2 THEN 'not a JSON object' WHEN 3 THEN 'not a list of values'
          WHEN 4 THEN 'empty value' WHEN 5 THEN 'value that isn''t a string' WHEN 6 THEN 'no dimensions' END AS problem
        FROM documents WHERE doc_id % 7 > 0""",
    "generic_nodes": "SELECT dimension, value, true AS covered FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in GENERIC_TAXONOMY.items() for v in vs) + ") t(dimension, value) WHERE (SELECT count(*) FROM documents) > 0",
    "vector_table": """SELECT vec_id AS id, CAST(label AS VARCHAR) AS domain, CAST(len(embedding) AS INTEGER) AS width, round(CAST(CAST(embedding[1] AS FLOAT) AS DOUBLE), 5) AS first
        FROM embeddings WHERE CAST(label AS VARCHAR) = (SELECT min(CAST(label AS VARCHAR)) FROM embeddings)""",
    "screen_passed": f"WITH {_SCREEN} SELECT doc_id FROM documents JOIN q USING (doc_id) WHERE s = 1",
    "example_count": f"""WITH {PAIRS}, {_GOOD}, {_SAMPLE} SELECT 'all' AS which, count(*) AS n FROM ok
        UNION ALL SELECT 'orders', count(*) FROM ok JOIN nodes n ON n.node_id = 'orders-' || lpad(CAST(conv_id AS VARCHAR), 6, '0')""",
    "stream_screened": """SELECT doc_id, (r // 3) AS batch, CAST(r % 3 AS INTEGER) AS pos, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS prefilter_score
        FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS r FROM documents)""",
    "dedup_text": _first_wins_sql(),
    "dedup_two_batches": _first_wins_sql(),
    "dedup_two_layers": _first_wins_sql(", v AS MATERIALIZED (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))", f" UNION ALL {_COSINE}"),
    "run_waves": f"""WITH {PAIRS}, t AS (SELECT count(DISTINCT conv_id) // 2 AS target FROM conversations), u AS (SELECT target, greatest(3 * target // 2, target + 1) AS n FROM t),
        j AS (SELECT conv_id, {_VERDICT} = 'accept' AS ok FROM (SELECT *, {_HUNDREDTHS.format(n='(length(prompt) + length(completion))')} AS h FROM pairs WHERE prompt <> '' AND completion <> '')),
        s AS (SELECT conv_id, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS no FROM j GROUP BY 1),
        l AS (SELECT list(coalesce(ok, 0) ORDER BY i) AS ok, list(coalesce(no, 0) ORDER BY i) AS no FROM (SELECT range AS i FROM range((SELECT n FROM u))) LEFT JOIN s ON conv_id = i),
        w(wave, asked, asked_to, accepted_count, rejected_count) AS (
          SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
          SELECT wave + 1, size, asked_to + size, CAST(least(target, accepted_count + list_sum(l.ok[asked_to + 1:asked_to + size])) AS BIGINT), CAST(rejected_count + list_sum(l.no[asked_to + 1:asked_to + size]) AS BIGINT)
          FROM (SELECT *, greatest(1, least(n - asked_to, CASE WHEN asked_to = 0 THEN (3 * (target - accepted_count) + 19) // 20 WHEN accepted_count = 0 THEN 2 * asked_to
            ELSE (11 * (target - accepted_count) * asked_to + 10 * accepted_count - 1) // (10 * accepted_count) END)) AS size FROM w, u WHERE accepted_count < target AND asked_to < n), l)
        SELECT *, 2 * accepted_count AS covered FROM w WHERE wave > 0""",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_kept_counts": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_kept_gaps": """WITH c AS (SELECT dimension, value, count(*) AS n FROM (SELECT 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT dimension, value, CAST(2 * m - n AS BIGINT) AS deficit FROM c, (SELECT sum(n) // count(*) AS m FROM c) WHERE 2 * m > n""",
    "stream_coverage": "SELECT dimension, value, count(*) AS n FROM (SELECT 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
}
ORACLES["nearest_indexed"] = ORACLES["nearest"]
ORACLES = {k: v.replace("WITH ", "WITH RECURSIVE ", 1) if ("walk(" in v or "w(wave" in v) and "RECURSIVE" not in v else v for k, v in ORACLES.items()}
