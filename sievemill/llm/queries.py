"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, langid, line_dedup, mixing, neardup, ngram_join, packing, phrases, pii, quality, sharding, topk, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, k=8, percent=80)
    return kept.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("n_chars"), F.crc32("text").alias("text_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.integer_components(F.col("embedding")).alias("q"))
    rows = rows.where("q is not null")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    said = langid.identify(docs, model)
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, quantile=0.99).drop("text_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_documents(docs, weights=[3, 1, 2], percent=150).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"), least=100, top=2000)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_neardup": op4_neardup,
    "op5_sharding": op5_sharding,
    "op6_langid": op6_langid,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_toxicity": op12_toxicity,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        m AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
            + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
            + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INT) AS mask
          FROM d LEFT JOIN l USING (doc_id)
        ), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
        o(o) AS (SELECT '' UNION ALL SELECT o || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
        b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        s AS (
          SELECT o AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS f, (SELECT bit FROM b WHERE b.f = o[step]) AS own,
            coalesce((SELECT sum(bit) FROM b WHERE contains(o[1:step - 1], b.f)), 0)::INT AS before
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5
        ), r AS (
          SELECT part, filter_order, step, f,
            sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM c, s GROUP BY 1, 2, 3, 4
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op13_phrases": r"""
        WITH p AS (
          SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
        g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        kept AS (
          SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
            SELECT 1 FROM f y WHERE y.lang = f.lang AND y.k > f.k AND 100 * y.f >= 100 * f.f AND contains(' ' || y.phrase || ' ', ' ' || f.phrase || ' '))
        ), cut AS (
          SELECT kept.lang, kept.phrase, kept.f AS a, c, array_to_string(string_split(kept.phrase, ' ')[1:c], ' ') AS x, array_to_string(string_split(kept.phrase, ' ')[c + 1:], ' ') AS y
          FROM kept, (SELECT unnest([1, 2, 3, 4]) AS c) WHERE c < k
        ), s AS (
          SELECT cut.lang, cut.phrase, a, c, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
          FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN total ON total.lang = cut.lang
        ), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000""",
    "op4_neardup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
            AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), e AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        n AS (SELECT a, count(*) AS n FROM e GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id,
               least(vec_id, coalesce(m.b, vec_id)) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
    "op9_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ), g AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [md5(array_to_string(w[i:i+4], ' ')) FOR i IN range(1, len(w) - 3)]
                                 WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op3_topk": """
        WITH v AS (
          SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
