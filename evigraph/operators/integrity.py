"""Checks of stored tables as (check, violations) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHECKS = ("foreign_key_violations", "edges_without_evidence", "edge_weight_mismatches", "edge_first_seen_mismatches", "node_mention_count_mismatches", "node_first_seen_mismatches", "evidence_observed_before_source_scraped", "mentions_observed_before_source_scraped", "edge_last_seen_stale")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """G1: rows whose reference names no parent; null references don't count."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def _counted(rows: DataFrame, **bad: Column) -> DataFrame:
    """(check, violations) of one table, all its checks in one aggregate."""
    counts = rows.agg(*[F.count_if(c).alias(name) for name, c in bad.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in bad])))


def audit(edges: DataFrame, nodes: DataFrame, evidence: DataFrame, sources: DataFrame, mentions: DataFrame) -> DataFrame:
    """G1-G9. edges: id, source, target, weight, first_seen, last_seen; nodes: id, mention_count, first_seen; evidence: edge_id,
    source_id, observed_at; sources: id, source_url, scraped_at, last_scraped_at; mentions: node_id, source_id, observed_at.

    Every table is read with its parents by outer joins and gives all its counts in one aggregate."""
    src = sources.select(F.col("id").alias("source_id"), "source_url", "scraped_at", "last_scraped_at", F.lit(True).alias("has_source"))
    named = lambda df, c, alias: df.select(F.col(c).alias(alias), F.lit(True).alias(f"has_{alias}"))
    lost = lambda c, has: F.col(c).isNotNull() & F.col(has).isNull()
    ev = evidence.select("edge_id", "source_id", "observed_at").join(src, "source_id", "left")
    me = mentions.select("node_id", "source_id", "observed_at").join(src, "source_id", "left")
    known = F.when(F.col("has_source"), F.col("observed_at"))
    by_edge = ev.groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("rows"), F.count_distinct("source_url").alias("n"), F.min(known).alias("first"), F.max("last_scraped_at").alias("scraped"))
    by_node = me.groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("source_url").alias("n"), F.min(known).alias("first"))
    e = edges.join(by_edge, "id", "left").join(named(nodes, "id", "source"), "source", "left").join(named(nodes, "id", "target"), "target", "left")
    n = nodes.join(by_node, "id", "left")
    early = F.col("observed_at") < F.col("scraped_at")
    none = F.coalesce("n", F.lit(0))
    parts = [
        _counted(e, foreign_key_violations=lost("source", "has_source"), edges_without_evidence=F.col("rows").isNull(), edge_weight_mismatches=F.col("weight") != none, edge_first_seen_mismatches=F.col("first_seen") != F.col("first"), edge_last_seen_stale=F.col("last_seen") < F.col("scraped")),
        _counted(e, foreign_key_violations=lost("target", "has_target")),
        _counted(ev.join(named(edges, "id", "edge_id"), "edge_id", "left"), foreign_key_violations=lost("source_id", "has_source"), evidence_observed_before_source_scraped=early),
        _counted(evidence.join(named(edges, "id", "edge_id"), "edge_id", "left"), foreign_key_violations=lost("edge_id", "has_edge_id")),
        _counted(n, node_mention_count_mismatches=F.col("mention_count") != none, node_first_seen_mismatches=F.col("first_seen") != F.col("first")),
        _counted(me, foreign_key_violations=lost("source_id", "has_source"), mentions_observed_before_source_scraped=early),
        _counted(mentions.join(named(nodes, "id", "node_id"), "node_id", "left"), foreign_key_violations=lost("node_id", "has_node_id")),
    ]
    return reduce(DataFrame.unionAll, parts).groupBy("check").agg(F.sum("violations").alias("violations"))


def _one_of(column: str, *values: str) -> Column:
    return F.col(column).isin(*values)


def _filled(column: str) -> Column:
    return F.col(column) != ""


def rules() -> dict[str, dict[str, Column]]:
    """What must hold in each row of each stored table; a rule that is null holds (fixed values)."""
    c = F.col
    return {
        "crawl_runs": {"run_status": _one_of("status", "running", "complete", "partial", "failed"), "run_order": c("finished_at") >= c("started_at"), "run_finished": (c("status") == "running") | c("finished_at").isNotNull(), "run_summary": c("summary_json").isNull() | F.try_parse_json("summary_json").isNotNull()},
        "sources": {"source_url": _filled("source_url"), "requested_url": _filled("requested_url"), "source_type": _one_of("source_type", "news", "discussion", "microblog", "official", "analysis"), "source_body": _filled("body"), "source_hash": _filled("content_hash"), "source_order": c("last_scraped_at") >= c("scraped_at")},
        "nodes": {"node_name": F.trim("name") != "", "node_normalized": _filled("normalized_name"), "node_type": _one_of("entity_type", "PERSON", "ORG", "LOCATION", "TOPIC"), "node_mentions": c("mention_count") >= 0, "node_key": c("key") == F.concat_ws(":", "entity_type", "normalized_name")},
        "edges": {"edge_relation": _filled("relation_type"), "edge_weight": c("weight") >= 1, "edge_self": c("source_node_id") != c("target_node_id"), "edge_ends": c("directed") | (c("source_node_id") < c("target_node_id")), "edge_order": c("last_seen") >= c("first_seen")},
        "edge_sources": {"evidence_text": _filled("evidence_text"), "evidence_segment": _filled("segment_id"), "evidence_start": c("start_offset") >= 0, "evidence_end": c("end_offset") >= c("start_offset"), "evidence_rule": _filled("rule_id"), "evidence_tier": _one_of("quality_tier", "semantic_rule", "cooccurrence")},
        "node_mentions": {"mention_occurrences": c("occurrence_count") >= 1},
        "node_aliases": {"alias_key": _filled("alias_key"), "alias_kind": _filled("alias_kind"), "alias_origin": _filled("origin")},
    }


#: Keys that may not repeat.
UNIQUE = {"sources": ["source_url", "content_hash"], "nodes": ["key"], "edges": ["source_node_id", "target_node_id", "relation_type"], "edge_sources": ["edge_id", "source_id"], "node_mentions": ["node_id", "source_id"], "node_aliases": ["alias_key", "node_id"]}


def constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """G10 over stored tables: (check, violations) of all rules, nulls in required columns, and repeated keys."""
    every, found = rules(), []
    for name, table in tables.items():
        own = {k: r for k, r in every.get(name, {}).items()}
        optional = {"finished_at", "summary_json", "title", "author", "published_at"}
        needed = {f"{name}_{x}_missing": F.col(x).isNotNull() for x in table.columns if x not in optional}
        found.append(constraint_violations(table, own | needed))
        if name in UNIQUE:
            again = table.groupBy(*UNIQUE[name]).agg(F.count("*").alias("n")).where("n > 1")
            found.append(again.agg(F.count("*").alias("violations")).select(F.lit(f"{name}_unique").alias("check"), "violations"))
    return reduce(DataFrame.unionAll, found)


def constraint_violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule; all rules are counted in one pass."""
    counts = table.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in rules])
    return counts.select(F.inline(pairs))


def problems(audited: DataFrame) -> list[str]:
    """G11: "check: count" of failed checks."""
    return [f"{r.check}: {r.violations}" for r in audited.where("violations > 0").orderBy("check").collect()]
