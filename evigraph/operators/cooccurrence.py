"""Weak links between entities of one sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ENTITIES = 8


def sentence_entities(mentions: DataFrame, sentence: list[str], entity: str = "entity", most: int = MAX_ENTITIES) -> DataFrame:
    """One row per sentence with its number of different entities and, if these are at most `most`, their sorted list.

    Entities are made different before they are counted, in one shuffle by sentence; only short lists are collected."""
    distinct = mentions.select(*sentence, entity).repartition(*sentence).distinct()
    n = distinct.groupBy(*sentence).agg(F.count("*").alias("n"), F.collect_list(entity).alias("entities"))
    return n.withColumn("entities", F.when(F.col("n") <= most, F.array_sort("entities")))


def pairs(mentions: DataFrame, sentence: list[str], entity: str = "entity", most: int = MAX_ENTITIES, kind: str | None = None) -> DataFrame:
    """(sentence, a, b) with a < b; a sentence of more than `most` entities gives none, so pairs are bounded per row.
    With a column `kind`, two entities that are both TOPIC make no pair."""
    what = F.struct(F.col(entity).alias("e"), (F.col(kind) if kind else F.lit("")).alias("k"))
    few = sentence_entities(mentions.select(*sentence, what.alias("x")), sentence, "x", most).where(F.col("n") <= most)
    one = few.select(*sentence, "entities", F.posexplode("entities").alias("i", "a"))
    both = one.select(*sentence, "a", F.explode(F.slice("entities", F.col("i") + 2, F.size("entities"))).alias("b"))
    return both.where((F.col("a.k") != "TOPIC") | (F.col("b.k") != "TOPIC")).select(*sentence, F.col("a.e").alias("a"), F.col("b.e").alias("b"))


def skipped(mentions: DataFrame, sentence: list[str], entity: str = "entity", most: int = MAX_ENTITIES) -> DataFrame:
    n = mentions.select(*sentence, entity).distinct().groupBy(*sentence).agg(F.count("*").cast("int").alias("entities"))
    return n.where(F.col("entities") > most)


def without_semantic(weak: DataFrame, semantic: DataFrame, item: str) -> DataFrame:
    """Drops pairs that a typed relation links anywhere in the item. semantic: item, a, b in any order."""
    known = semantic.select(item, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return weak.join(known, [item, "a", "b"], "left_anti")


def first_wins(relations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the order."""
    return relations.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
