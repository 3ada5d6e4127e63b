"""W1-W18 in one batch: fetched pages to items, mentions, relations and the next snapshot of the graph's tables.

Tables: sources, nodes, edges, edge_sources, node_mentions, node_aliases, crawl_runs (FIXTURES F1). A batch publishes all of
its tables at once; pages that are no item are rows of the report, they don't fail the batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_names
from ..operators import cooccurrence, dependency, identity, mentions, reports, store
from ..operators.graph import edge_weights, mention_counts
from ..sources.config import Config, Vocabulary
from ..sources.pages import normalize

RULES_VERSION = "rules-1"
#: An annotator takes segments (item, ord, segment_id, text) and gives tokens, as operators.mentions and dependency take them, and spans.
Annotator = Callable[[DataFrame, dict[str, DataFrame]], tuple[DataFrame, DataFrame]]
NO_TREE = {"lemma": "string", "dep": "string", "head": "int", "ent_type": "string"}


def gazetteer(segments: DataFrame, vocab: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The annotator without a parser: words by rule, names of the vocabulary as spans, the longest first."""
    tokens = mentions.annotate(segments)
    spans = mentions.longest_first(mentions.phrases(tokens, vocab["pinned"], exact=True))
    return tokens, spans.select("item", "segment_id", "first", "last", F.col("name").alias("label"))


def extracted(segments: DataFrame, vocab: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame], annotator: Annotator = gazetteer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, relations, warnings) of segments (item, ord, segment_id, text); `keep` writes and rereads a table."""
    tokens, spans = annotator(segments, vocab)
    tokens, spans = keep(tokens, "tokens"), keep(spans, "annotated")
    tokens = tokens.select("*", *[(F.col("i") if c == "head" else F.lit("").cast(t)).alias(c) for c, t in NO_TREE.items() if c not in tokens.columns])
    found, ambiguous = identity.identify(mentions.candidates(tokens, spans, segments, vocab, keep), tokens, vocab["names"], keep)
    rows = found.select("*")
    emitted = keep(dependency.relations(tokens, rows, segments), "emitted")
    warnings = emitted.where("warning IS NOT NULL").select("item", "warning").unionByName(ambiguous.select("item", F.concat(F.lit("Ambiguous surname '"), "text", F.lit("' left unresolved: "), F.array_join("options", ", ")).alias("warning")))
    place = Window.partitionBy("item").orderBy("sent", "first", "last")
    named = rows.select("item", "key", "entity_type", F.col("canonical").alias("canonical_name"), F.col("text").alias("name"), "segment_id", "start", "end", "resolution", F.row_number().over(place).alias("ord"))
    return named, dependency.kept_relations(emitted).drop("warning"), warnings


def ingest(spark: SparkSession, fetched: DataFrame, config: Config, vocabulary: Vocabulary, to: store.Snapshots, run_id: int, as_of, annotator: Annotator = gazetteer) -> dict:  # type: ignore[no-untyped-def]
    """One batch of fetched pages (columns of sources.pages.FETCHED with source_name and fetched_at) into the next snapshot;
    returns the run's report."""
    keep = store.Scratch(spark)
    old = {t: to.read(t) for t in to.tables()}
    profiles = spark.createDataFrame([(p.name, p.source_type, p.adapter, p.body_selector, list(p.exclude_selectors)) for p in config.sources], "source_name string, source_type string, adapter string, body_selector string, exclude_selectors array<string>")
    rows = fetched.drop("adapter", "body_selector", "exclude_selectors").withColumn("page_id", F.monotonically_increasing_id())
    pages = keep(rows.join(F.broadcast(profiles), "source_name"), "pages")  # a configuration's rows
    items = normalize(pages, "page_id", config.crawl.max_comments_per_thread, config.crawl.max_body_characters)
    items = items.join(pages.select("page_id", "source_name", "source_type", "requested_url", F.col("fetched_at").alias("scraped_at"), "status_code", "success", "error", "depth"), "page_id")
    items = items.withColumns({"content_hash": store.content_hash(), "ord": F.col("page_id")})
    items = keep(items, "items")
    good = items.where("reason IS NULL")
    kind = "id long, source_url string, requested_url string, source_type string, scraped_at timestamp, last_scraped_at timestamp, title string, body string, author string, published_at timestamp, content_hash string, segments array<struct<id: string, text: string, kind: string, author: string, parent_id: string, url: string, published_at: timestamp>>"
    sources = old.get("sources", spark.createDataFrame([], kind))
    fresh = store.new_versions(good.where("source_url IS NOT NULL"), sources.select("source_url", "content_hash"))
    last = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = keep(store.with_ids(fresh.withColumn("last_scraped_at", F.col("scraped_at")).drop("id"), last(sources), ["scraped_at", "page_id"]), "fresh")
    sources = store.refreshed(sources, good).unionByName(fresh.select(*sources.columns))
    sources = keep(sources, "sources")

    parts = keep(fresh.select(F.col("id").alias("item"), F.posexplode("segments").alias("ord", "s")).select("item", "ord", F.col("s.id").alias("segment_id"), F.col("s.text").alias("text")), "segments")
    vocab = vocabulary.frames(spark)
    named, related, warnings = extracted(parts, vocab, keep, annotator)
    named, related = keep(named, "named"), keep(related, "related")
    if faults := store.key_faults(named).limit(1).collect():
        raise ValueError(f"mention key {faults[0].key!r} does not match its type and name")
    per_item = keep(store.collect_nodes(named), "per_item")
    checked = keep(store.checked_relations(related, per_item, parts.select("item", "segment_id", "text")), "checked")

    # Keys that aren't stored get ids; the first display name stays
    node_kind = "id long, key string, name string, normalized_name string, entity_type string, first_seen timestamp, mention_count long"
    nodes = old.get("nodes", spark.createDataFrame([], node_kind))
    new = per_item.join(nodes.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("name", "item").alias("name"), F.min_by("entity_type", "item").alias("entity_type"), F.min("item").alias("_at"))
    new = store.with_ids(new, last(nodes), ["_at", "key"]).withColumn("normalized_name", normalized_names(F.col("name")))
    ids = keep(nodes.select("id", "key", "name", "normalized_name", "entity_type").unionByName(new.select("id", "key", "name", "normalized_name", "entity_type")), "ids")
    key_id = ids.select("key", F.col("id").alias("node_id"))

    # Mentions of a source, W13: the first evidence of an edge in a source; the clock of the batch, not before the fetch
    clock = fresh.select(F.col("id").alias("item"), F.greatest(F.lit(as_of).cast("timestamp"), "scraped_at").alias("observed_at"))
    seen = per_item.join(key_id, "key").join(clock, "item").select("node_id", F.col("item").alias("source_id"), F.col("observed_at").alias("first_observed_at"), "surface_forms", "occurrence_count")
    node_mentions = keep(seen if "node_mentions" not in old else old["node_mentions"].unionByName(seen), "node_mentions")
    good_relations = checked.where("status = 'ok'").join(key_id.select(F.col("key").alias("source_key"), F.col("node_id").alias("source_node_id")), "source_key").join(key_id.select(F.col("key").alias("target_key"), F.col("node_id").alias("target_node_id")), "target_key")
    good_relations = store.canonical_ends(good_relations)
    ends = ["source_node_id", "target_node_id", "relation_type"]
    edge_kind = "id long, source_node_id long, target_node_id long, relation_type string, directed boolean, weight long, first_seen timestamp, last_seen timestamp"
    edges = old.get("edges", spark.createDataFrame([], edge_kind))
    every = edges.select(*ends, "directed").unionByName(good_relations.select(*ends, "directed"))
    if store.direction_conflicts(every).limit(1).count():
        raise ValueError("an edge is stored with both directions")
    first = good_relations.join(edges.select(*ends), ends, "left_anti").groupBy(*ends, "directed").agg(F.min(F.struct("item", "sent", "ord")).alias("_at"))
    first = store.with_ids(first.select(*ends, "directed", "_at.item", "_at.sent", "_at.ord"), last(edges), ["item", "sent", "ord", *ends])
    edge_ids = keep(edges.select("id", *ends, "directed").unionByName(first.select("id", *ends, "directed")), "edge_ids")
    ev = cooccurrence.first_wins(good_relations.join(edge_ids.select(F.col("id").alias("edge_id"), *ends), ends), ["edge_id", "item"], ["sent", "ord"]).join(clock, "item")
    ev = ev.select("edge_id", F.col("item").alias("source_id"), "observed_at", "evidence_text", "segment_id", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "rule_id", "quality_tier")
    stored = old.get("edge_sources")
    ev = store.with_ids(ev, last(stored) if stored is not None else 0, ["observed_at", "source_id", "edge_id"])
    evidence = keep(ev if stored is None else stored.unionByName(ev.select(*stored.columns)), "evidence")

    # Derived counts, from all evidence and mentions
    url = sources.select(F.col("id").alias("source_id"), "source_url")
    weighted = edge_weights(evidence.join(url, "source_id").join(edge_ids.select(F.col("id").alias("edge_id"), F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"), "relation_type"), "edge_id"))
    weighted = weighted.select(F.col("source").alias("source_node_id"), F.col("target").alias("target_node_id"), "relation_type", "weight", "first_seen", "last_seen")
    edges = store.refreshed_edges(edge_ids.join(weighted, ends).select(*[x.split()[0] for x in edge_kind.split(", ")]), evidence, sources)
    counts = mention_counts(node_mentions.join(url, "source_id").select(F.col("node_id").alias("node"), F.lit("").alias("entity_type"), "source_url", F.col("first_observed_at").alias("observed_at"))).select(F.col("node").alias("id"), "mention_count", "first_seen")
    nodes = ids.join(counts, "id").select(*[x.split()[0] for x in node_kind.split(", ")])

    # Written names and reviewed aliases of the nodes of this batch
    written = store.mention_aliases(named).join(key_id, "key").select("alias_key", "node_id", "alias_kind", F.lit("mention").alias("origin"))
    reviewed = identity.reviewed_aliases(vocab["entries"]).join(key_id, "key").select("alias_key", "node_id", "alias_kind", F.lit("reviewed").alias("origin"))
    aliases = old.get("node_aliases", spark.createDataFrame([], "alias_key string, node_id long, alias_kind string, origin string"))
    aliases = aliases.unionByName(store.best_aliases(written.unionByName(reviewed), aliases).select(*aliases.columns))

    version = store.extractor_version(RULES_VERSION, annotator.__name__, vocabulary.version.encode())
    known = good.join(fresh.select("page_id", F.lit(True).alias("_new")), "page_id", "left").select("page_id", F.col("_new").isNull().alias("known"))
    told = items.join(known, "page_id", "left").select(F.col("source_name").alias("source"), "depth", reports.outcome([*items.columns, "known"]).alias("outcome"), F.coalesce("reason", "error").alias("reason"), F.when(F.col("reason").isNull(), F.size("segments")).alias("segments"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "title", "author", "published_at")
    told = keep(told, "told")
    failed = {r.source: r["count"] for r in told.where("depth = 0 AND NOT outcome LIKE 'stored%' AND NOT coalesce(reason, '') LIKE 'listing_page%'").groupBy("source").count().collect()}  # a row per source
    runs = store.start_run(old.get("crawl_runs"), spark, run_id, as_of, config.config_hash, version)
    to.publish(version, sources=sources, nodes=nodes, edges=edges, edge_sources=evidence, node_mentions=node_mentions, node_aliases=aliases.distinct(), crawl_runs=runs)
    problems = graph_problems(to)
    head = {"run_id": run_id, "started_at": as_of, "extractor_version": version, "config_hash": config.config_hash, "rejected": {r.status: r["count"] for r in checked.where("status != 'ok'").groupBy("status").count().collect()}, "item_warnings": {r.kind: r["count"] for r in warnings.withColumn("kind", reports.warning_kind()).groupBy("kind").count().collect()}}
    got = to.pinned()
    graph = reports.graph_report(got.read("sources"), got.read("nodes"), got.read("edges"), got.read("edge_sources"), got.read("node_aliases"))
    report = reports.run_report(head, reports.tallies(told), reports.reasons(told), graph, problems, failed)
    to.publish(version, crawl_runs=store.finish_run(got.read("crawl_runs"), run_id, as_of, report["status"], json.dumps(report, default=str)))
    keep.drop()
    return report


def graph_problems(to: store.Snapshots) -> list[str]:
    """G1-G9, G11 over the newest snapshot."""
    from ..operators.integrity import audit, problems

    s = to.pinned()
    edges = s.read("edges").withColumnsRenamed({"source_node_id": "source", "target_node_id": "target"})
    mentions_ = s.read("node_mentions").withColumnRenamed("first_observed_at", "observed_at")
    return problems(audit(edges, s.read("nodes"), s.read("edge_sources"), s.read("sources"), mentions_))
