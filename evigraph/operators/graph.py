"""Analysis of a typed, evidence-backed multigraph: weights, growth, centrality, networks, resolution, citations.

Tables: observations (edge_id, source, target, relation_type, source_url, observed_at), nodes (id, name, entity_type,
mention_count), edges (id, source, target, relation_type, directed, weight, first_seen, last_seen). Ids may be of any
type that has an order."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

MAX_NODES, MAX_EDGES, MAX_PAGE, MAX_OFFSET = 200, 500, 100, 1_000_000


class EntityNotFound(LookupError):
    code = "entity_not_found"


class AmbiguousEntity(LookupError):
    code = "ambiguous_entity"

    def __init__(self, name: str, candidates: list[dict]):
        super().__init__(f"{len(candidates)} entities match {name!r}")
        self.candidates = candidates


def page_bounds(limit: int, offset: int) -> None:
    """Q11."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be from 0 to {MAX_OFFSET}")


def edge_weights(observations: DataFrame) -> DataFrame:
    """One row per edge; its weight is the number of different source urls."""
    key = ["source", "target", "relation_type"]
    return observations.groupBy(*key).agg(F.count_distinct("source_url").alias("weight"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def mention_counts(mentions: DataFrame) -> DataFrame:
    """Sources that name a node, and when it was first seen. mentions: node, entity_type, source_url, observed_at."""
    return mentions.groupBy("node", "entity_type").agg(F.count_distinct("source_url").alias("mention_count"), F.min("observed_at").alias("first_seen"))


def growth(observations: DataFrame, since, as_of, key: list[str] | None = None) -> DataFrame:
    """Q5: per edge the urls first seen before `since`, those added up to `as_of`, and the latest of these."""
    key = key or ["source", "target", "relation_type"]
    firsts = observations.groupBy(*key, "source_url").agg(F.min("observed_at").alias("t"))
    added = (F.col("t") >= since) & (F.col("t") <= as_of)
    return firsts.groupBy(*key).agg(F.count_if(F.col("t") < since).alias("baseline"), F.count_if(added).alias("added"), F.max(F.when(added, F.col("t"))).alias("latest")).where("added > 0")


def at_least_ratio(added: Column, baseline: Column, ratio: str | float) -> Column:
    """added / baseline >= ratio without rounding: the ratio is the fraction that its decimal text names."""
    r = Fraction(Decimal(str(ratio)))
    whole = lambda c: c.cast("decimal(19,0)")
    return whole(added) * F.lit(Decimal(r.denominator)).cast("decimal(19,0)") >= whole(baseline) * F.lit(Decimal(r.numerator)).cast("decimal(19,0)")


def new_connections(observations: DataFrame, since, as_of, min_delta: int = 3, min_ratio: str | float = "0.5", key: list[str] | None = None) -> DataFrame:
    """Q6: edges without earlier support, and those whose support grew by enough in number and share."""
    if min_delta < 1 or Fraction(str(min_ratio)) <= 0:
        raise ValueError("growth thresholds must be positive")
    if since > as_of:
        raise ValueError("since must not be later than as_of")
    g = growth(observations, since, as_of, key)
    grown = (F.col("added") >= min_delta) & at_least_ratio(F.col("added"), F.col("baseline"), min_ratio)
    g = g.withColumn("reason", F.when(F.col("baseline") == 0, "new").when(grown, "grown")).where("reason IS NOT NULL")
    return g.withColumn("relative_growth", F.when(F.col("baseline") > 0, F.col("added") / F.col("baseline")))


def growth_page(found: DataFrame, key: list[str], limit: int, offset: int) -> DataFrame:
    """A page in the order of Q6: most added, latest contribution, key."""
    page_bounds(limit, offset)
    return found.orderBy(F.desc("added"), F.desc("latest"), *key).offset(offset).limit(limit)


def connections(observations: DataFrame, edges: DataFrame, nodes: DataFrame, since, as_of, min_delta: int = 3, min_ratio: str | float = "0.5", limit: int = 20, offset: int = 0) -> dict:  # type: ignore[no-untyped-def]
    """Q6 as a response: a page of new and grown edges with both ends, and the total. observations: edge_id, source_url, observed_at."""
    found = new_connections(observations, since, as_of, min_delta, min_ratio, ["edge_id"])
    page = growth_page(found, ["edge_id"], limit, offset)
    rows = page.join(edge_details(edges, nodes).withColumnRenamed("id", "edge_id"), "edge_id").orderBy(F.desc("added"), F.desc("latest"), "edge_id").collect()  # one page
    items = [
        {"edge_id": str(r.edge_id), **edge_summary(r), "reason": r.reason, "weight_before": r.baseline, "weight_now": r.baseline + r.added, "weight_delta": r.added, "relative_growth": r.relative_growth, "latest_contribution": r.latest, "evidence_url": f"/edges/{r.edge_id}/sources"}
        for r in rows
    ]
    return {"since": since, "as_of": as_of, "thresholds": {"min_delta": min_delta, "min_ratio": min_ratio}, "items": items, "total": found.count(), "limit": limit, "offset": offset}


def edge_summary(r) -> dict:  # type: ignore[no-untyped-def]
    end = lambda p, i: {"id": str(r[i]), "name": r[f"{p}_name"], "entity_type": r[f"{p}_entity_type"], "mention_count": r[f"{p}_mention_count"]}
    return {"source": end("s", "source"), "target": end("t", "target"), **{c: r[c] for c in ("relation_type", "directed", "first_seen", "last_seen")}}


def incident(edges: DataFrame) -> DataFrame:
    """Both directions of every edge but loops."""
    e = edges.where("source <> target")
    return e.select(F.col("source").alias("node"), F.col("target").alias("other"), "relation_type", "weight").unionAll(e.select("target", "source", "relation_type", "weight"))


def central(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q8: degree, relation types and weighted degree of every node, with the share of all others that it touches."""
    by = incident(edges).groupBy("node").agg(F.count_distinct("other").alias("degree"), F.count_distinct("relation_type").alias("relation_type_count"), F.sum("weight").alias("weighted_degree"))
    n = nodes.agg(F.count("*").alias("node_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = nodes.join(by, nodes.id == by.node, "left").crossJoin(F.broadcast(n))  # one row
    out = out.select(nodes["*"], zero("degree"), zero("relation_type_count"), zero("weighted_degree"), "node_count")
    return out.withColumn("score", F.when(F.col("node_count") > 1, F.col("degree") / (F.col("node_count") - 1)).otherwise(F.lit(0.0)))


def central_page(nodes: DataFrame, edges: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the ranking; only the page is numbered."""
    page_bounds(limit, offset)
    order = [F.desc("degree"), F.desc("relation_type_count"), F.desc("weighted_degree"), F.col("id")]
    page = central(nodes, edges).orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)


#: Ids of a breadth-first level that are broadcast at once; beyond it the level is joined by shuffle.
MOST_IDS = 1_000_000


def neighbours(edges: DataFrame, frontier: DataFrame, few: bool = False) -> DataFrame:
    """Q2: nodes one edge away in either direction. frontier: id; `few` says that its size was checked."""
    ids = frontier.select("id").distinct()
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("next")).unionAll(edges.select("target", "source"))
    return ends.join(F.broadcast(ids) if few else ids, "id", "left_semi").select(F.col("next").alias("id")).distinct()


def distances(edges: DataFrame, root, depth: int = 2, max_nodes: int = MAX_NODES) -> DataFrame:  # type: ignore[no-untyped-def]
    """(id, distance) by breadth-first search; no level is opened once more than max_nodes are known.

    The second level opens if the first has at most max_nodes - 1 nodes; that one count decides the plan, and such a level
    is broadcast."""
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    kind = edges.schema["source"].dataType.simpleString()
    start = edges.sparkSession.createDataFrame([(root, 0)], f"id {kind}, distance int")
    first = neighbours(edges, start, True).where(F.col("id") != F.lit(root)).withColumn("distance", F.lit(1))
    if depth == 1:
        return start.unionByName(first)
    known = first.limit(min(max_nodes, MOST_IDS) + 1).count() + 1
    if known > max_nodes:
        return start.unionByName(first)
    few = known <= MOST_IDS
    own = start.unionByName(first)
    ids = own.select("id")
    second = neighbours(edges, first, few).join(F.broadcast(ids) if few else ids, "id", "left_anti").withColumn("distance", F.lit(2))
    return own.unionByName(second)


def _ranked(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "id").orderBy("distance", F.desc("mention_count"), "id")


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept nodes (id, distance) with the nearer and farther distance of their ends."""
    small = kept.limit(MAX_NODES * 100 + 1).count() <= MAX_NODES * 100
    side = lambda c, d: (F.broadcast if small else lambda x: x)(kept.select(F.col("id").alias(c), F.col("distance").alias(d)))
    near, far = side("source", "ds"), side("target", "dt")
    return edges.join(near, "source").join(far, "target").withColumn("near", F.least("ds", "dt")).withColumn("far", F.greatest("ds", "dt"))


def network(nodes: DataFrame, edges: DataFrame, root, depth: int = 2, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, dict]:  # type: ignore[no-untyped-def]
    """Q3, Q4: (nodes, edges, meta) around a node. At most max_nodes + 1 ranked nodes come to the driver, which go back as a
    local table, so nothing is cached and the graph isn't searched again for each use."""
    if max_nodes < 1 or max_edges < 1:
        raise ValueError("max_nodes and max_edges must be positive")
    ranked = _ranked(nodes, distances(edges, root, depth, max_nodes)).limit(max_nodes + 1)
    top = ranked.collect()  # a response's nodes
    spark, schema = nodes.sparkSession, ranked.schema.add("place", IntegerType())
    kept = spark.createDataFrame([(*r, k) for k, r in enumerate(top[:max_nodes], 1)], schema)
    inner = induced_edges(edges, kept)
    kept_nodes, kept_edges = connected_selection(kept, inner, max_edges)
    more_nodes, more_edges = len(top) > max_nodes, inner.limit(max_edges + 1).count() > max_edges
    reason = {(True, True): "max_nodes_and_max_edges", (True, False): "max_nodes", (False, True): "max_edges"}.get((more_nodes, more_edges))
    return kept_nodes, kept_edges, {"root_id": root, "depth": depth, "truncated": reason is not None, "reason": reason, "max_nodes": max_nodes, "max_edges": max_edges}


def connected_selection(kept: DataFrame, inner: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """Q4: every returned node keeps its heaviest edge towards the root; nodes that the edge budget can't reach are left out,
    what is left of it goes to the other edges in the order near, far, heaviest, id."""
    ends = inner.select("id", "weight", F.col("source").alias("child"), F.col("ds").alias("dc"), F.col("dt").alias("do")).unionAll(inner.select("id", "weight", "target", "dt", "ds"))
    first = Window.partitionBy("child").orderBy(F.desc("weight"), "id")
    parents = ends.where("dc > 0 AND do = dc - 1").withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("child"), F.col("id").alias("parent_edge"))
    ranked = kept.join(parents, kept.id == parents.child, "left").where("distance = 0 OR parent_edge IS NOT NULL")
    ranked = ranked.withColumn("k", F.row_number().over(Window.orderBy("place")) - 1).where(F.col("k") <= max_edges).drop("child", "k")
    must = ranked.where("distance > 0").select(F.col("parent_edge").alias("id")).distinct().withColumn("must", F.lit(1))
    both = inner.join(ranked.select(F.col("id").alias("source")), "source", "left_semi").join(ranked.select(F.col("id").alias("target")), "target", "left_semi")
    fill = Window.orderBy(F.coalesce("must", F.lit(2)), "near", "far", F.desc("weight"), "id")
    chosen = both.join(must, "id", "left").withColumn("k", F.row_number().over(fill)).where(F.col("k") <= max_edges).drop("k", "must")
    return ranked.drop("parent_edge"), chosen


def resolve(nodes: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """Q1 for many keys: (key, id, candidates) of every node whose normalised name or alias is the key."""
    by_name = nodes.select("id", F.col("normalized_name").alias("key")).join(keys, "key").select("key", "id")
    by_alias = aliases.select(F.col("node_id").alias("id"), F.col("alias_key").alias("key")).join(keys, "key").select("key", "id")
    found = by_name.union(by_alias).distinct()
    return found.withColumn("candidates", F.count("*").over(Window.partitionBy("key")))


def resolve_entity(nodes: DataFrame, aliases: DataFrame, name: str, entity_id=None) -> dict:
    """Q1: the one node that a name means; raises with the candidates where it may mean several."""
    from ..functions.text import normalize_name

    key = normalize_name(name)
    if not key:
        raise EntityNotFound("an entity name is required")
    keys = nodes.sparkSession.createDataFrame([(key,)], "key string")
    found = nodes.join(resolve(nodes, aliases, keys).select("id"), "id", "left_semi")
    if entity_id is not None:
        found = found.where(F.col("id") == F.lit(entity_id))
    rows = [r.asDict() for r in found.orderBy("id").limit(MAX_PAGE).collect()]  # a page of candidates is shown
    if not rows:
        raise EntityNotFound(f"no entity matches {name!r}" + f" with entity_id {entity_id}" * (entity_id is not None))
    if len(rows) > 1:
        raise AmbiguousEntity(name, rows)
    return rows[0]


def edge_details(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q7: edges with names, types and mention counts of both ends."""
    end = lambda p: nodes.select(F.col("id").alias({"s": "source", "t": "target"}[p]), *[F.col(c).alias(f"{p}_{c}") for c in ("name", "entity_type", "mention_count")])
    return edges.join(end("s"), "source").join(end("t"), "target")


def edge_sources(evidence: DataFrame, sources: DataFrame, edge_id=None) -> DataFrame:  # type: ignore[no-untyped-def]
    """Q9: citations with the segment they stand in; a segment id that repeats in a source gives a row each."""
    e = evidence if edge_id is None else evidence.where(F.col("edge_id") == F.lit(edge_id))
    segments = sources.select(F.col("id").alias("source_id"), F.explode_outer("segments").alias("segment"))
    fields = [f.name for f in sources.schema["segments"].dataType.elementType.fields]
    own = segments.select("source_id", F.col("segment.id").alias("segment_id"), *[F.col(f"segment.{c}").alias(f"segment_{c}") for c in ("kind", "author", "url", "published_at") if c in fields])
    return e.join(sources.withColumnRenamed("id", "source_id").drop("segments"), "source_id").join(own, ["source_id", "segment_id"], "left")


#: What of a citation a response shows; bodies and metadata never leave (fixed values).
EVIDENCE = ("source_url", "source_type", "title", "author", "published_at", "scraped_at", "last_scraped_at", "observed_at", "evidence_text", "segment_id", "segment_kind", "segment_author", "segment_url", "segment_published_at", "start_offset", "end_offset", "rule_id", "quality_tier")


class EdgeNotFound(LookupError):
    code = "edge_not_found"


def evidence_page(evidence: DataFrame, sources: DataFrame, edge_id=None, limit: int = 20, offset: int = 0) -> DataFrame:  # type: ignore[no-untyped-def]
    """Q9: a page of an edge's citations, oldest observation first, then by id."""
    page_bounds(limit, offset)
    return edge_sources(evidence, sources, edge_id).orderBy("observed_at", "id").offset(offset).limit(limit)


def citations(edges: DataFrame, nodes: DataFrame, evidence: DataFrame, sources: DataFrame, edge_id, limit: int = 20, offset: int = 0) -> dict:  # type: ignore[no-untyped-def]
    """Q9 as a response: the edge, a page of citations and the total."""
    page_bounds(limit, offset)
    edge = edge_details(edges.where(F.col("id") == F.lit(edge_id)), nodes).first()
    if edge is None:
        raise EdgeNotFound(f"no edge has id {edge_id}")
    rows = [r.asDict() for r in evidence_page(evidence, sources, edge_id, limit, offset).collect()]
    items = [{"evidence_id": str(r["id"]), "source_id": str(r["source_id"]), **{c: r.get(c) for c in EVIDENCE}} for r in rows]
    return {"edge": {"id": str(edge_id), **edge_summary(edge), "weight": edge.weight}, "items": items, "total": evidence.where(F.col("edge_id") == F.lit(edge_id)).count(), "limit": limit, "offset": offset}


def graph_counts(**tables: DataFrame) -> DataFrame:
    """(name, value) row counts."""
    parts = [t.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
