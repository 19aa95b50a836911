"""Queries over the supplied tables: one ``opN_<name>`` for each operator, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridact.llm import ann, decontamination, language_id, mixing, ngram_lm, secrets, simhash, substring_dedup, token_counts, warc
from veridact.llm.common import crc_mod, materialize, table

TOKENIZER = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, 'about:blank') AS uri, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS least
  FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to,
       uri
FROM p
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    found = language_id.identify(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans", "lang_spans")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = materialize(secrets.scan(docs).drop("text"), "op9")
    return secrets.find(scanned, secrets.discovery_thresholds(scanned)).drop("secret_base", "secret_candidates")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT source, source_size, weight,
         (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS onward
  FROM w
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * max((total - before) / onward) OVER ()) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_warc, op3_substring_dedup, op4_decontamination, op5_ngram_lm, op6_simhash, op7_language_id, op8_ann, op9_secrets, op10_mixing)
}
ORACLE = {"op2_warc": OP2_SQL, "op10_mixing": OP10_SQL}
