"""Queries opN_<name> over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, line_dedup, substring_dedup, toxicity, warc
from .common import table
from .packing import pack
from .repetition import judge
from .sharding import shard
from .token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op5_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "response.refers_to")


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.where("leaked")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op4_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents")).drop("mark")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text", "n_lines", "n_dropped")


OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT page_id, h, n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_hilbert_packing, op2_token_counts, op3_repetition, op4_collinear_passages, op5_transactions, op6_chosen_path_join, op7_interleaved_shards, op8_bm25_decontamination, op9_toxicity, op10_fuzzy_lines)}


def oracle_sql() -> dict[str, str]:
    return {"op5_transactions": OP5}
