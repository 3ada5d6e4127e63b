"""The corpus pipeline: five operators in a row, each stage written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from evigraph.llm.common import Kept, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id is not in `gone`; documents with no id stay."""
    return docs.join(gone.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(docs, model).where("rejected"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each line; a document that lost all its lines goes, and n_chars follows the text."""
    got = line_dedup.dedup_lines(docs).where("NOT (n_dropped > 0 AND text = '')")
    return got.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    got = jaccard_join.near_classes(docs).where("doc_id = class_id OR doc_id IS NULL").select("doc_id", "mark").distinct()
    marked = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = marked.join(got.where("doc_id IS NOT NULL"), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return one.unionByName(marked.where("doc_id IS NULL")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds a test item's question and answer."""
    return _without(docs, decontamination.search(docs, table(spark, sf_dir, "benchmark")).where("leaked"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as pieces with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Kept(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = kept.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
