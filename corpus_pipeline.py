"""The corpus pipeline: quality, line dedup, near-duplicate documents, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before wrote, and all but the last return the
columns of ``documents``. A stage works on all that its predecessor kept.

In every stage: other columns of ``docs``, whatever their names, are left out; an empty table gives an empty result; very long texts are texts
like others; rows repeated whole are judged alike (of repeated rows the near-duplicate stage keeps one); null ids, languages and sources are
values like others. What a stage does with null and empty texts is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import line_dedup, mixing, ngram_join, packing, quality
from sievemill.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Copies of a row are judged alike; null, empty and blank texts go."""
    said = quality.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(F.col("doc_id").alias("_id"), "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(said["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == said["text_key"])
    return docs.join(said, same, "left_semi").select(COLUMNS)


def keep_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; those of which nothing is left go, null, empty and blank texts among them."""
    kept = line_dedup.dedup_lines(docs.select(COLUMNS)).where("n_kept > 0")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near-duplicates.

    Rows are told apart by a key of their own, not by ``doc_id``: rows that repeat an id are copies or different texts like any others,
    rows without an id come last in their group. Rows without any word are in no group and stay.
    """
    rows = stored(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    said = ngram_join.ngram_components(rows.select(F.col("row").alias("doc_id"), "text"))
    said = said.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id", F.xxhash64("text").alias("key")), "row")
    first = said.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "row")).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last copy in part where it takes one in part; texts without a word aren't taken."""
    return mixing.copies_of(mixing.mix_documents(docs.select(COLUMNS)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null and empty texts have their end token only."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", keep_lines),
    ("n-gram Jaccard join", keep_distinct),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
