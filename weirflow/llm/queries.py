"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import exact_dedup, fingerprints, language_id, line_dedup, media, mixing, near_dedup, packing, resampling, suffix_dedup, token_counts, toxicity, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, told apart by ``kind``, as one corpus; a row has the id of its own table.

    The documents' declared language stands for their markup's, their source for their host; they have no address.
    """
    none = F.lit(None)
    docs = documents(spark, sf_dir).select(F.lit("document").alias("kind"), "doc_id", none.cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), none.cast("string").alias("suffix"))
    pages = language_id.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    pages = pages.select(F.lit("page").alias("kind"), none.cast("long").alias("doc_id"), "page_id", "text", "declared", "host", "suffix")
    found = language_id.identify(docs.unionByName(pages), "text", "declared", "host", "suffix")
    return found.select("kind", "doc_id", "page_id", "declared", "language.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed.select("doc_id", "source", "mix.*")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the 400 bytes of the contract, ``n_repeated`` tells of shorter passages: of fifty words, seldom under 256 bytes."""
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), also=256)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_line_dedup, op4_mixing, op5_media_columns, op6_suffix_dedup, op7_toxicity, op8_minhash_near_dedup, op9_token_counts, op10_best_fit_packing, op11_embedding_whitening, op12_importance_resampling, op13_document_fingerprints)}

ORACLES = {
    "op3_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        repeated AS (
            SELECT key, max(doc_id) AS top_doc FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.top_doc AS lost FROM keyed k LEFT JOIN repeated r USING (key))
        GROUP BY doc_id""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    # The CRC-32 of each feature byte by byte, from a table that the first rows make.
    "op12_importance_resampling": r"""
        WITH steps AS (
            SELECT list(c ORDER BY n) AS t FROM (
                SELECT n, list_reduce([n] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
        texts AS (SELECT 1 AS corpus, doc_id, text FROM documents UNION ALL SELECT 0, item_id, text FROM benchmark),
        words AS (
            SELECT corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        runs AS (
            SELECT corpus, doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS f FROM words, range(1, 4) s(k)),
        counted AS (SELECT corpus, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
        hashed AS (
            SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM counted)), steps),
        cells AS (SELECT corpus, doc_id, bucket, n FROM counted JOIN hashed USING (f)),
        sums AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 1), 0) AS s, coalesce(sum(n) FILTER (corpus = 0), 0) AS t FROM cells GROUP BY 1),
        totals AS (SELECT sum(s) AS total_s, sum(t) AS total_t FROM sums),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (total_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (total_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, totals),
        weights AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight FROM words
            LEFT JOIN (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM cells JOIN gains USING (bucket) WHERE corpus = 1 GROUP BY 1) USING (doc_id) WHERE corpus = 1),
        scored AS (
            SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score, n_words >= 20 AS able FROM weights),
        placed AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (able) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM placed""",
}
