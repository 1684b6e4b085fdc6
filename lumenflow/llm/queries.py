"""The ten operators as queries over their whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, token_counts, toxicity, url_filter
from .common import table

#: A unigram vocabulary: pieces and scores of a sentencepiece model file.
VOCABULARY = os.environ.get("LUMENFLOW_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")

#: Shards so small that tables of any size split, and some documents are larger than a shard.
SHARD_BYTES = 64 << 10

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, position, edits: every document that holds a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected (true): the documents that the ordinal model selects."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, quality_classifier.grades(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model).where("selected")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, distance, kept (true): the documents within their group's ellipsoid."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).where("kept")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, finish_time, total_tokens: what weighted fair queueing serves within the budget."""
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("h")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toxicity, toxic (true): the documents that the induced lexicon rejects."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.induce(docs, table(spark, sf_dir, "labels"))).where("toxic")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard_id, shard_bytes of every document, in shards of SHARD_BYTES."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard_id", "shard_bytes")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, copy_of, copies, links: each document that another one is near to or equal to."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, score, accepted (true): the pages whose URL the two language models accept; trained on the list's labels, as there are no others."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.score(pages, url_filter.train(url_filter.listed(pages))).where("accepted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, start, end, found, value: every identifier, disguised or not."""
    return pii.spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_quality_classifier, op3_quality_rules, op4_source_mixing, op5_token_counts, op6_toxicity, op7_sharding, op8_ngram_jaccard_join, op9_url_filter, op10_pii)}

_WEIGHT = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in mixing.WEIGHTS.items())

ORACLES: dict[str, str] = {
    "op4_source_mixing": f"""
        WITH entry AS (
            SELECT source, doc_id, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\s]+')), 0)) AS BIGINT) AS n_tokens,
                   md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   CASE source {_WEIGHT} ELSE {mixing.DEFAULT_WEIGHT}::DOUBLE END AS weight
            FROM documents GROUP BY source, doc_id),
        timed AS (
            SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE) / weight AS finish_time FROM entry),
        served AS (
            SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish_time, h, doc_id NULLS FIRST, source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_tokens FROM timed)
        SELECT doc_id, source, n_tokens, finish_time, total_tokens FROM served
        WHERE total_tokens <= (SELECT CAST(floor(sum(n_tokens) * {mixing.BUDGET_SHARE}) AS BIGINT) FROM entry)""",
    "op7_sharding": f"""
        WITH d AS (
            SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
        sums AS (
            SELECT bits, h >> (60 - bits) AS q, sum(bytes) AS total FROM d, generate_series(0, 60) AS g(bits) GROUP BY ALL),
        leaf AS (
            SELECT d.doc_id, d.h, min(bits) AS bits, max(total) AS shard_bytes FROM d, sums
            WHERE q = h >> (60 - bits) AND (total <= {SHARD_BYTES} OR bits = 60) GROUP BY d.doc_id, d.h)
        SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, CAST(bits AS INT)) AS shard_id, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM leaf""",
}
