"""All queries of the engine by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import cooccurrence, frontier, graph, identity, integrity, mentions, reports, store
from ..sources import pages
from ..streaming.first_seen import into_snapshots
from . import views
from .views import B1, E1, E2, table

Query = Callable[[SparkSession, str], DataFrame]
SINCE, AS_OF, ROOT = datetime.datetime(2024, 1, 22), datetime.datetime(2024, 12, 31), "PERSON:user-8"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def shown(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
GROWTH = f"""WITH {E1},
firsts AS (SELECT source, target, relation_type, source_url, min(observed_at) AS t FROM ev GROUP BY 1, 2, 3, 4),
g AS (SELECT source, target, relation_type, count(*) FILTER (t < TIMESTAMP '2024-01-22') AS baseline,
  count(*) FILTER (t >= TIMESTAMP '2024-01-22' AND t <= TIMESTAMP '2024-12-31') AS added,
  max(t) FILTER (t >= TIMESTAMP '2024-01-22' AND t <= TIMESTAMP '2024-12-31') AS latest FROM firsts GROUP BY 1, 2, 3)
SELECT source, target, relation_type, baseline, added, CASE WHEN baseline = 0 THEN 'new' ELSE 'grown' END AS reason, {TS.format('latest')}
FROM g WHERE added > 0 AND (baseline = 0 OR (added >= 3 AND added * DEN >= baseline * NUM))"""


def _growth(spark: SparkSession, sf_dir: str, ratio: str) -> DataFrame:
    got = graph.new_connections(views.events_graph(spark, sf_dir), SINCE, AS_OF, 3, ratio)
    return got.select("source", "target", "relation_type", "baseline", "added", "reason", shown("latest"))


@query(GROWTH.replace("DEN", "2").replace("NUM", "1"))
def growth_new_or_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _growth(spark, sf_dir, "0.5")


@query(GROWTH.replace("DEN", "10").replace("NUM", "3"))
def growth_exact_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _growth(spark, sf_dir, "0.3")


@query(f"WITH {E1} SELECT source, target, relation_type, count(DISTINCT source_url) AS weight, {TS.format('first_seen')}, {TS.format('last_seen')} FROM (SELECT *, min(observed_at) OVER w AS first_seen, max(observed_at) OVER w AS last_seen FROM ev WINDOW w AS (PARTITION BY source, target, relation_type)) GROUP BY source, target, relation_type, first_seen, last_seen")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_weights(views.events_graph(spark, sf_dir)).select("source", "target", "relation_type", "weight", shown("first_seen"), shown("last_seen"))


def _mentions(ev: DataFrame) -> DataFrame:
    ends = ev.select(F.col("source").alias("node"), "source_url", "observed_at").unionAll(ev.select("target", "source_url", "observed_at"))
    return ends.withColumn("entity_type", F.substring_index("node", ":", 1))


@query(f"WITH {E1}, m AS (SELECT source AS node, source_url, observed_at FROM ev UNION ALL SELECT target, source_url, observed_at FROM ev), a AS (SELECT node, split_part(node, ':', 1) AS entity_type, count(DISTINCT source_url) AS mention_count, min(observed_at) AS first_seen FROM m GROUP BY 1, 2) SELECT node, entity_type, mention_count, {TS.format('first_seen')} FROM a")
def node_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mention_counts(_mentions(views.events_graph(spark, sf_dir))).withColumn("first_seen", shown("first_seen"))


CENTRAL = f"""WITH {E2}, i AS (SELECT source AS node, target AS other, relation_type, weight FROM edges WHERE source <> target UNION ALL SELECT target, source, relation_type, weight FROM edges WHERE source <> target),
c AS (SELECT n.id, n.mention_count, count(DISTINCT other) AS degree, count(DISTINCT relation_type) AS relation_type_count, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weighted_degree FROM nodes n LEFT JOIN i ON i.node = n.id GROUP BY 1, 2)
SELECT id, mention_count, degree, relation_type_count, weighted_degree, round(degree / (SELECT count(*) - 1 FROM nodes), 9) AS score"""


@query(CENTRAL + " FROM c")
def central_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.central(*views.purchases_graph(spark, sf_dir)).select("id", "mention_count", "degree", "relation_type_count", "weighted_degree", F.round("score", 9).alias("score"))


@query(CENTRAL + ", CAST(row_number() OVER (ORDER BY degree DESC, relation_type_count DESC, weighted_degree DESC, id) AS INT) AS rank FROM c ORDER BY rank LIMIT 20")
def central_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.central_page(*views.purchases_graph(spark, sf_dir)).select("id", "mention_count", "degree", "relation_type_count", "weighted_degree", F.round("score", 9).alias("score"), "rank")


HOPS = f"""WITH {E2}, u AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
d0 AS (SELECT '{ROOT}' AS id, 0 AS distance), d1 AS (SELECT DISTINCT b AS id, 1 AS distance FROM u WHERE a = '{ROOT}' AND b <> '{ROOT}'),
d2 AS (SELECT DISTINCT b AS id, 2 AS distance FROM u WHERE a IN (SELECT id FROM d1) AND b <> '{ROOT}' AND b NOT IN (SELECT id FROM d1))"""


@query(HOPS + " SELECT id, distance, mention_count FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) JOIN nodes USING (id)")
def network_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.purchases_graph(spark, sf_dir)
    return nodes.join(graph.distances(edges, ROOT, 1), "id").select("id", "distance", "mention_count")


@query(HOPS + " SELECT id, distance, mention_count FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) JOIN nodes USING (id)")
def network_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.purchases_graph(spark, sf_dir)
    return nodes.join(graph.distances(edges, ROOT, 2, 1 << 31), "id").select("id", "distance", "mention_count")


KEPT = ", k AS (SELECT id, distance, row_number() OVER (ORDER BY distance, mention_count DESC, id) AS place FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) JOIN nodes USING (id) QUALIFY place <= %d), inner_e AS (SELECT e.*, least(s.distance, t.distance) AS near, greatest(s.distance, t.distance) AS far, s.distance AS ds, t.distance AS dt FROM edges e JOIN k s ON e.source = s.id JOIN k t ON e.target = t.id)"


@query(HOPS + KEPT % 50 + " SELECT source, target, relation_type, weight, near, far FROM inner_e")
def network_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.purchases_graph(spark, sf_dir)
    kept = nodes.join(graph.distances(edges, ROOT, 2, 1 << 31), "id").orderBy("distance", F.desc("mention_count"), "id").limit(50)
    return graph.induced_edges(edges, kept).select("source", "target", "relation_type", "weight", "near", "far")


@query(HOPS + KEPT % 40 + """, ends AS (SELECT id, weight, source AS child, ds AS dc, dt AS d_o FROM inner_e UNION ALL SELECT id, weight, target, dt, ds FROM inner_e),
par AS (SELECT child, id AS parent FROM ends WHERE dc > 0 AND d_o = dc - 1 QUALIFY row_number() OVER (PARTITION BY child ORDER BY weight DESC, id) = 1),
r AS (SELECT k.*, parent FROM k LEFT JOIN par ON k.id = par.child WHERE distance = 0 OR parent IS NOT NULL QUALIFY row_number() OVER (ORDER BY place) - 1 <= 30),
c AS (SELECT i.*, CASE WHEN i.id IN (SELECT parent FROM r WHERE distance > 0) THEN 1 ELSE 2 END AS must FROM inner_e i WHERE source IN (SELECT id FROM r) AND target IN (SELECT id FROM r))
SELECT id, weight, near, far FROM c QUALIFY row_number() OVER (ORDER BY must, near, far, weight DESC, id) <= 30""")
def network_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.purchases_graph(spark, sf_dir)
    return graph.network(nodes, edges, ROOT, 2, 40, 30)[1].select("id", "weight", "near", "far")


@query(f"WITH {E2}, n AS (SELECT id, split_part(id, ':', 2) AS name FROM nodes), a AS (SELECT split_part(name, '-', 2) AS key, id FROM n UNION ALL SELECT '@' || name, id FROM n) SELECT key, id, count(*) OVER (PARTITION BY key) AS candidates FROM a")
def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = views.purchases_graph(spark, sf_dir)
    n = nodes.withColumn("normalized_name", F.substring_index("id", ":", -1))
    number = F.substring_index("normalized_name", "-", -1)
    aliases = n.select(number.alias("alias_key"), F.col("id").alias("node_id")).unionAll(n.select(F.concat(F.lit("@"), "normalized_name"), "id"))
    return graph.resolve(n, aliases, aliases.select(F.col("alias_key").alias("key")).distinct())


@query(f"WITH {E1} SELECT id AS evidence_id, source_url, 'post' AS segment_kind, {TS.format('observed_at')} FROM ev WHERE source = '{ROOT}' AND target = 'TOPIC:k-3' ORDER BY ev.observed_at, id LIMIT 50")
def evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events_graph(spark, sf_dir).withColumn("edge_id", F.concat_ws("|", "source", "target"))
    segment = F.struct(F.lit("body").alias("id"), F.lit("post").alias("kind"), F.lit(None).cast("string").alias("author"))
    sources = ev.select(F.col("source_url").alias("id"), "source_url").distinct().withColumn("segments", F.array(segment))
    evidence = ev.select("id", "edge_id", F.col("source_url").alias("source_id"), "observed_at", F.lit("body").alias("segment_id"))
    page = graph.evidence_page(evidence, sources, f"{ROOT}|TOPIC:k-3", 50)
    return page.select(F.col("id").alias("evidence_id"), "source_url", "segment_kind", shown("observed_at"))


@query(f"""WITH {E2}, n AS (SELECT *, split_part(id, ':', 1) AS entity_type FROM nodes)
SELECT e.id, s.entity_type AS s_entity_type, s.mention_count AS s_mention_count, t.entity_type AS t_entity_type, t.mention_count AS t_mention_count, e.weight FROM edges e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id""")
def edge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.purchases_graph(spark, sf_dir)
    named = nodes.withColumns({"name": F.substring_index("id", ":", -1), "entity_type": F.substring_index("id", ":", 1)})
    return graph.edge_details(edges, named).select("id", "s_entity_type", "s_mention_count", "t_entity_type", "t_mention_count", "weight")


@query("SELECT conv_id AS source_id, 'turn-' || turn AS segment_id, CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS segment_kind, role AS segment_author FROM conversations")
def evidence_segment_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    one = F.struct(F.concat(F.lit("turn-"), "turn").alias("id"), F.when(F.col("turn") == 0, "post").otherwise("comment").alias("kind"), F.col("role").alias("author"))
    sources = c.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(one).alias("segments"))
    evidence = c.select(F.col("conv_id").alias("source_id"), F.concat(F.lit("turn-"), "turn").alias("segment_id")).distinct()
    return graph.edge_sources(evidence, sources).select("source_id", "segment_id", "segment_kind", "segment_author")


@query(f"WITH {E1} SELECT 'edges' AS name, count(*) AS value FROM (SELECT DISTINCT source, target, relation_type FROM ev) UNION ALL SELECT 'evidence', count(*) FROM ev UNION ALL SELECT 'nodes', count(*) FROM (SELECT source FROM ev UNION SELECT target FROM ev) UNION ALL SELECT 'sources', count(DISTINCT source_url) FROM ev")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events_graph(spark, sf_dir)
    return graph.graph_counts(edges=ev.select("source", "target", "relation_type").distinct(), evidence=ev, nodes=ev.select("source").union(ev.select("target")).distinct(), sources=ev.select("source_url").distinct())


REPORT = f"""WITH {E1}, s AS (SELECT DISTINCT source_url, CASE WHEN right(source_url, 1) IN ('0', '5') THEN 'news' ELSE 'official' END AS source_type FROM ev),
v AS (SELECT ev.*, source || '|' || target || '|' || relation_type AS edge_id, CASE WHEN relation_type = 'purchase' THEN 'semantic_rule' ELSE 'cooccurrence' END AS tier, source_type FROM ev JOIN s USING (source_url)),
n AS (SELECT source AS id FROM ev UNION SELECT target FROM ev)
SELECT name, part, CAST(value AS BIGINT) AS value FROM (
SELECT 'sources' AS name, '' AS part, count(*) AS value FROM s UNION ALL SELECT 'source_urls', '', count(*) FROM s UNION ALL SELECT 'nodes', '', count(*) FROM n
UNION ALL SELECT 'nodes_by_type', split_part(id, ':', 1), count(*) FROM n GROUP BY 2
UNION ALL SELECT 'edges', '', count(DISTINCT edge_id) FROM v UNION ALL SELECT 'edges_by_relation_type', relation_type, count(DISTINCT edge_id) FROM v GROUP BY 2
UNION ALL SELECT 'evidence', '', count(*) FROM v UNION ALL SELECT 'edges_by_quality_tier', tier, count(DISTINCT edge_id) FROM v GROUP BY 2
UNION ALL SELECT 'evidence_by_quality_tier', tier, count(*) FROM v GROUP BY 2
UNION ALL SELECT 'evidence_by_source_type_and_tier', source_type || '/' || tier, count(*) FROM v GROUP BY 2
UNION ALL SELECT 'semantic_evidence_by_source_type_and_relation', source_type || '/' || relation_type, count(*) FROM v WHERE tier = 'semantic_rule' GROUP BY 2)"""


@query(REPORT)
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events_graph(spark, sf_dir).withColumn("edge_id", F.concat_ws("|", "source", "target", "relation_type"))
    sources = ev.select(F.col("source_url").alias("id"), "source_url").distinct().withColumn("source_type", F.when(F.right("source_url", F.lit(1)).isin("0", "5"), "news").otherwise("official"))
    nodes = ev.select(F.col("source").alias("id")).union(ev.select("target")).distinct().withColumn("entity_type", F.substring_index("id", ":", 1))
    evidence = ev.select("edge_id", F.col("source_url").alias("source_id"), F.when(F.col("relation_type") == "purchase", "semantic_rule").otherwise("cooccurrence").alias("quality_tier"))
    return reports.graph_report(sources, nodes, ev.select(F.col("edge_id").alias("id"), "relation_type").distinct(), evidence)


def _audit(spark: SparkSession, sf_dir: str, corrupt: bool | str) -> DataFrame:
    ev = views.events_graph(spark, sf_dir).withColumn("edge_id", F.concat_ws("|", "source", "target", "relation_type"))
    edges = graph.edge_weights(ev).withColumn("id", F.concat_ws("|", "source", "target", "relation_type"))
    seen = ev.groupBy("source_url").agg(F.min("observed_at").alias("scraped_at"))
    sources = seen.select(F.col("source_url").alias("id"), "source_url", "scraped_at", F.col("scraped_at").alias("last_scraped_at"))
    evidence = ev.select("edge_id", F.col("source_url").alias("source_id"), "observed_at")
    mentions = _mentions(ev).select(F.col("node").alias("node_id"), F.col("source_url").alias("source_id"), "observed_at")
    nodes = graph.mention_counts(_mentions(ev)).withColumnRenamed("node", "id")
    if corrupt == "times":
        day, name = F.expr("INTERVAL 1 DAY"), F.col("id")
        edges = edges.withColumn("first_seen", F.when(F.col("target") == "TOPIC:k-2", F.col("first_seen") - day).otherwise(F.col("first_seen")))
        bare = edges.where("target = 'TOPIC:k-4'").withColumns({"id": F.concat_ws("|", "source", "target", F.lit("none")), "weight": F.lit(0).cast("long")}).dropDuplicates(["id"])
        edges = edges.unionByName(bare)
        nodes = nodes.withColumn("first_seen", F.when(name.isin("PERSON:user-1", "PERSON:user-2", "TOPIC:k-1"), F.col("first_seen") - day).otherwise(F.col("first_seen")))
        sources = sources.withColumns({"scraped_at": F.when(name == "2024-01-05", F.col("scraped_at") + F.expr("INTERVAL 100 DAYS")).otherwise(F.col("scraped_at")), "last_scraped_at": F.when(name == "2024-01-09", F.lit(AS_OF) + F.expr("INTERVAL 900 DAYS")).otherwise(F.col("last_scraped_at"))})
    elif corrupt:
        nodes = nodes.where("id <> 'PERSON:user-7'").withColumn("mention_count", F.col("mention_count") + (F.col("id") == "PERSON:user-8").cast("int"))
        edges = edges.withColumn("weight", F.when(F.col("target") == "TOPIC:k-1", F.lit(0)).otherwise(F.col("weight")))
    return integrity.audit(edges, nodes, evidence, sources, mentions)


CHECKS = "(VALUES ('foreign_key_violations', {fk}), ('edges_without_evidence', 0), ('edge_weight_mismatches', {w}), ('edge_first_seen_mismatches', 0), ('node_mention_count_mismatches', {m}), ('node_first_seen_mismatches', 0), ('evidence_observed_before_source_scraped', 0), ('mentions_observed_before_source_scraped', 0), ('edge_last_seen_stale', 0)) t(\"check\", violations)"


@query("SELECT \"check\", CAST(violations AS BIGINT) AS violations FROM " + CHECKS.format(fk=0, w=0, m=0))
def integrity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, False)


@query(f"WITH {E1}, fk AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT source, target, relation_type FROM ev WHERE source = 'PERSON:user-7')) + (SELECT count(*) FROM ev WHERE source = 'PERSON:user-7') AS n), w AS (SELECT count(*) AS n FROM (SELECT DISTINCT source, target, relation_type FROM ev WHERE target = 'TOPIC:k-1')) SELECT \"check\", CAST(violations AS BIGINT) AS violations FROM (SELECT 'foreign_key_violations' AS \"check\", n AS violations FROM fk UNION ALL SELECT 'edge_weight_mismatches', n FROM w UNION ALL SELECT * FROM (VALUES ('edges_without_evidence', 0), ('edge_first_seen_mismatches', 0), ('node_mention_count_mismatches', 1), ('node_first_seen_mismatches', 0), ('evidence_observed_before_source_scraped', 0), ('mentions_observed_before_source_scraped', 0), ('edge_last_seen_stale', 0)))")
def integrity_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, True)


@query(f"""WITH {E1}, e AS (SELECT source, target, relation_type, list(DISTINCT source_url) AS urls FROM ev GROUP BY 1, 2, 3) SELECT * FROM (
SELECT 'foreign_key_violations' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'edges_without_evidence', count(DISTINCT source) FROM e WHERE target = 'TOPIC:k-4'
UNION ALL SELECT 'edge_weight_mismatches', 0 UNION ALL SELECT 'edge_first_seen_mismatches', count(*) FROM e WHERE target = 'TOPIC:k-2'
UNION ALL SELECT 'node_mention_count_mismatches', 0
UNION ALL SELECT 'node_first_seen_mismatches', count(*) FROM (SELECT source AS id FROM ev UNION SELECT target FROM ev) WHERE id IN ('PERSON:user-1', 'PERSON:user-2', 'TOPIC:k-1')
UNION ALL SELECT 'evidence_observed_before_source_scraped', count(*) FROM ev WHERE source_url = '2024-01-05'
UNION ALL SELECT 'mentions_observed_before_source_scraped', 2 * count(*) FROM ev WHERE source_url = '2024-01-05'
UNION ALL SELECT 'edge_last_seen_stale', count(*) FROM e WHERE list_contains(urls, '2024-01-09'))""")
def integrity_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, "times")


@query("""SELECT * FROM (SELECT 'node_mentions' AS "check", count(*) FILTER (o_orderkey % 10 = 0) AS violations FROM orders UNION ALL SELECT 'node_name', count(*) FILTER (o_orderkey % 7 = 0) FROM orders
UNION ALL SELECT 'node_type', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'node_key', count(*) FILTER (o_orderkey % 13 = 0) FROM orders UNION ALL SELECT 'node_normalized', 0)""")
def integrity_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    nodes = table(spark, sf_dir, "orders").select(
        F.when(k % 7 == 0, " ").otherwise(key).alias("name"), key.alias("normalized_name"), F.when(F.col("o_orderstatus") == "F", "THING").otherwise("ORG").alias("entity_type"), F.when(k % 10 == 0, -1).otherwise(1).alias("mention_count")
    )
    nodes = nodes.withColumn("key", F.concat_ws(":", "entity_type", F.when(F.col("normalized_name").cast("long") % 13 == 0, "x").otherwise(F.col("normalized_name"))))
    return integrity.constraint_violations(nodes, integrity.rules()["nodes"])


FEW = f"WITH {B1}, few AS (SELECT item FROM b GROUP BY item HAVING count(*) <= 8), p AS (SELECT x.item, x.entity AS a, y.entity AS b FROM b x JOIN b y ON x.item = y.item AND x.entity < y.entity WHERE x.item IN (SELECT item FROM few))"


@query(FEW + " SELECT a, b, count(*) AS weight FROM p GROUP BY 1, 2")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.pairs(views.baskets(spark, sf_dir), ["item"]).groupBy("a", "b").agg(F.count("*").alias("weight"))


@query(f"WITH {B1} SELECT item, CAST(count(*) AS INT) AS entities FROM b GROUP BY item HAVING count(*) > 8")
def cooccurrence_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.skipped(views.baskets(spark, sf_dir), ["item"])


@query(FEW + ", s AS (SELECT DISTINCT l1.l_orderkey AS item, least(p1.p_brand, p2.p_brand) AS a, greatest(p1.p_brand, p2.p_brand) AS b FROM lineitem l1 JOIN part p1 ON l1.l_partkey = p1.p_partkey JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey JOIN part p2 ON l2.l_partkey = p2.p_partkey WHERE p1.p_type = p2.p_type AND p1.p_brand < p2.p_brand) SELECT p.a, p.b, count(*) AS weight FROM p ANTI JOIN s ON p.item = s.item AND p.a = s.a AND p.b = s.b GROUP BY 1, 2")
def cooccurrence_minus_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    typed = cooccurrence.sentence_entities(parts, ["item", "p_type"], "p_brand", 1 << 30).where("n > 1")
    one = typed.select("item", "entities", F.posexplode("entities").alias("i", "a"))
    semantic = one.select("item", "a", F.explode(F.slice("entities", F.col("i") + 2, F.size("entities"))).alias("b"))
    weak = cooccurrence.pairs(views.baskets(spark, sf_dir), ["item"])
    return cooccurrence.without_semantic(weak, semantic, "item").groupBy("a", "b").agg(F.count("*").alias("weight"))


@query(f"WITH {E1} SELECT source, target, relation_type, source_url, id AS evidence_id FROM ev QUALIFY row_number() OVER (PARTITION BY source, target, relation_type, source_url ORDER BY id) = 1")
def first_relation_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cooccurrence.first_wins(views.events_graph(spark, sf_dir), ["source", "target", "relation_type", "source_url"], ["id"])
    return got.select("source", "target", "relation_type", "source_url", F.col("id").alias("evidence_id"))


VERSIONS = "WITH d AS (SELECT doc_id, source AS source_url, sha256(coalesce(text, '')) AS content_hash, CAST(doc_id % 7 AS BIGINT) AS scraped_at FROM documents), st AS (SELECT DISTINCT source_url, content_hash FROM d WHERE doc_id % 3 = 0) "


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_url"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("doc_id") % 7).alias("scraped_at"), F.col("doc_id").alias("ord"))
    stored = d.where("doc_id % 3 = 0").groupBy("source_url", "content_hash").agg(F.min("scraped_at").alias("last_scraped_at"))
    return d, stored


@query(VERSIONS + "SELECT source_url, content_hash, doc_id FROM d ANTI JOIN st USING (source_url, content_hash) QUALIFY row_number() OVER (PARTITION BY source_url, content_hash ORDER BY scraped_at, doc_id) = 1")
def versions_new_vs_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, stored = _versions(spark, sf_dir)
    return store.new_versions(items, stored.select("source_url", "content_hash")).select("source_url", "content_hash", "doc_id")


@query(VERSIONS + "SELECT source_url, content_hash, max(scraped_at) AS last_scraped_at FROM d SEMI JOIN st USING (source_url, content_hash) GROUP BY 1, 2")
def versions_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, stored = _versions(spark, sf_dir)
    return store.refreshed(stored, items).select("source_url", "content_hash", "last_scraped_at")


@query("SELECT o_orderkey AS key, CAST(100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id FROM orders")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_ids(table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_orderkey").alias("key")), 100, ["o_orderdate", "key"]).select("key", "id")


@query("SELECT l_orderkey AS item, l_linenumber AS ord, CASE WHEN l_suppkey % 11 = 0 THEN 'relations_skipped' WHEN l_partkey % 5 = l_suppkey % 5 THEN 'self_edges_rejected' WHEN l_linenumber = 3 THEN 'invalid_evidence' ELSE 'ok' END AS status FROM lineitem")
def relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("source_key"), F.when(F.col("l_suppkey") % 11 == 0, "none").otherwise(F.concat(F.lit("n"), F.col("l_suppkey") % 5)).alias("target_key"))
    r = l.withColumns({"segment_id": F.lit("body"), "start": F.lit(1), "end": F.when(F.col("ord") == 3, 1).otherwise(3), "evidence_text": F.when(F.col("ord") == 3, "").otherwise("bc"), "relation_type": F.lit("r"), "rule_id": F.lit("r.x")})
    items = l.select("item").distinct()
    nodes = items.withColumn("key", F.explode(F.array(*[F.lit(f"n{k}") for k in range(5)])))
    return store.checked_relations(r, nodes, items.withColumns({"segment_id": F.lit("body"), "text": F.lit("abcd")})).select("item", "ord", "status")


@query("SELECT 'v' || (o_custkey % 3) AS extractor_version, count(*) AS runs FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1")
def mixed_versions_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), F.col("o_custkey") % 3).alias("extractor_version"))
    return store.mixed_versions(runs, "v0")


#: The canonical form for addresses without port, credentials or escapes, as all of `pages` are.
CANON = """regexp_extract({0}, '^(https?://[^/?#]+)', 1) || CASE WHEN regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1) END
|| coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract({0}, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_.*|fbclid|gclid)='))), 'string_agg', '&'), ''), '')"""


@query(f"SELECT page_id, {CANON.format('url')} AS url FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_urls(F.col("url")).alias("url"))


@query("SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages")
def url_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "://", "://user:word@")  # credentials never show
    return table(spark, sf_dir, "pages").select("page_id", urls.safe_url(url).alias("url"))


#: (name, ord, seeds, allowed_domains, include_paths, listing_paths, max_depth, follow_links)
PROFILES = [
    ("alpha", 0, [], ["blog.tionsh.example.net", "thther.example.org"], ["^/en/"], ["^/fr/"], 2, "all"),
    ("beta", 1, [], ["blog.ththan.example.net", "blog.tiontion.example.com", "thther.example.org"], [], ["^/en/[5-9]"], 1, "all"),
    ("gamma", 2, [], ["spam-farm.example.org"], [], ["^/en/9"], None, "all"),
]
LINK = "CASE page_id % 8 WHEN 0 THEN 'http://10.0.0.' || (page_id % 200) || '/x' WHEN 1 THEN 'https://spam-farm.example.org/en/' || (page_id % 16) ELSE url END"


@query(f"""WITH l AS (SELECT page_id, CAST(page_id % 4 AS INT) AS depth, {LINK} AS link FROM pages), c AS (SELECT *, CASE WHEN link LIKE 'http://10.%' THEN NULL ELSE {CANON.format('link')} END AS url FROM l),
h AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/?]+([^?]*)', 1) AS path FROM c),
s AS (SELECT *, CASE WHEN host IN ('blog.tionsh.example.net', 'thther.example.org') AND regexp_matches(path, '^/(en|fr)/') THEN 'alpha'
  WHEN host IN ('blog.ththan.example.net', 'blog.tiontion.example.com', 'thther.example.org') THEN 'beta' WHEN host = 'spam-farm.example.org' THEN 'gamma' END AS source FROM h),
r AS (SELECT *, CASE WHEN depth > 2 THEN 'depth_limit' WHEN url IS NULL THEN 'invalid_url' WHEN source IS NULL THEN 'outside_source_policy' WHEN source = 'beta' AND depth > 1 THEN 'depth_limit'
  WHEN depth > 0 AND ((source = 'alpha' AND path LIKE '/fr/%') OR (source = 'beta' AND regexp_matches(path, '^/en/[5-9]')) OR (source = 'gamma' AND path LIKE '/en/9%')) THEN 'listing_not_seed' END AS early FROM s)
SELECT coalesce(reason, 'enqueued') AS reason, count(*) AS n FROM (SELECT CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY early IS NULL, url ORDER BY page_id) > 1 THEN 'duplicate_url' ELSE early END AS reason FROM r) GROUP BY 1""")
def url_policy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.expr(LINK).alias("link"), (F.col("page_id") % 4).cast("int").alias("depth"), F.lit(None).cast("string").alias("declared"))
    got = frontier.added(links, spark.createDataFrame(PROFILES, frontier.PROFILE), None, 2)
    return got.groupBy(F.coalesce("reason", F.lit("enqueued")).alias("reason")).agg(F.count("*").alias("n"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("source"), F.col("page_id").alias("ord"))


@query("WITH s AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source FROM pages), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_id) AS turn FROM s QUALIFY turn <= 5) SELECT source, page_id, CAST(row_number() OVER (ORDER BY turn, source) AS INT) AS place FROM t QUALIFY place <= 40")
def frontier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.frontier(_seeds(spark, sf_dir), 5, 40).select("source", "page_id", "place")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.titles(F.col("html")).alias("title"))


@query("SELECT page_id, page_id % 5 = 0 OR page_id % 7 = 1 AS value FROM pages")
def page_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 7 == 1, "<html><body><p>Access <b>denied</b></p></body></html>").when(F.col("page_id") % 5 == 0, F.concat(F.lit("<title>Just a moment...</title>"), "html")).otherwise(F.col("html"))
    got = pages.articles(table(spark, sf_dir, "pages").withColumn("html", html))
    return got.select("page_id", F.coalesce(F.col("reason").startswith("access_blocked"), F.lit(False)).alias("value"))


@query()
def page_article_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pages.articles(table(spark, sf_dir, "pages"))
    return got.select("page_id", text.headline(F.col("title")).alias("title"), F.length("body").alias("body_chars"), F.size("segments").alias("n_segments"), "reason")


#: Words of documents as tokens: what stands between blanks.
WORDS = "w AS (SELECT doc_id AS item, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS text, generate_subscripts(string_split_regex(text, '[ \\t\\n\\r]+'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)"
CAPS = "c AS (SELECT *, lead(text) OVER (PARTITION BY item ORDER BY i) AS follow FROM w)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words_of(table(spark, sf_dir, "documents").where("text IS NOT NULL"))


def _words_of(d: DataFrame) -> DataFrame:
    rows = d.select(F.col("doc_id").alias("item"), F.posexplode(F.split("text", r"[ \t\n\r]+")).alias("i", "text"))
    return rows.select("item", F.lit("body").alias("segment_id"), F.lit(0).alias("sent"), "i", "text", F.col("i").alias("start"), F.lit(True).alias("ws"), F.when(F.col("text").rlike("^[A-Z][a-z]+$"), "PROPN").otherwise("X").alias("pos"), F.lit("").alias("tag"))


def _frequent(words: DataFrame, pattern: str, n: int, lower: bool = False) -> DataFrame:
    rows = words.where(F.col("text").rlike(pattern)).select((F.lower("text") if lower else F.col("text")).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n).select("name", F.array("name").alias("words"))


@query(f"WITH {WORDS}, v AS (SELECT lower(text) AS topic FROM w WHERE regexp_matches(text, '^[A-Za-z]{{4,}}$') GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 20) SELECT item AS doc_id, topic, count(*) AS n FROM w JOIN v ON lower(w.text) = v.topic GROUP BY 1, 2")
def topic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    got = mentions.topic_mentions(words.drop("pos"), _frequent(words, "^[A-Za-z]{4,}$", 20, True))
    return got.groupBy(F.col("item").alias("doc_id"), F.col("name").alias("topic")).agg(F.count("*").alias("n"))


@query(f"WITH {WORDS}, v AS (SELECT text AS name FROM w WHERE regexp_matches(text, '^[A-Z][a-z]{{3,}}$') GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 30) SELECT item AS doc_id, name, CAST(i AS INT) AS start FROM w JOIN v ON w.text = v.name")
def gazetteer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    got = mentions.phrases(words, _frequent(words, "^[A-Z][a-z]{3,}$", 30), exact=True)
    return got.select(F.col("item").alias("doc_id"), "name", F.col("first").alias("start"))


@query(f"WITH {WORDS}, k AS (SELECT text FROM w WHERE regexp_matches(text, '^[A-Z][a-z]+$') GROUP BY 1 ORDER BY count(*) DESC, text LIMIT 5), low AS (SELECT DISTINCT item, text FROM w WHERE regexp_matches(text, '^[a-z]{{2,}}$')) SELECT DISTINCT w.item AS doc_id, w.text AS word FROM w LEFT JOIN low ON w.item = low.item AND lower(w.text) = low.text WHERE regexp_matches(w.text, '^[A-Z][a-z]+$') AND (low.text IS NULL OR w.text IN (SELECT text FROM k))")
def common_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    found = words.where("pos = 'PROPN'").select("item", "text", F.lower("text").alias("surface"), F.lit("ORG").alias("label"), F.col("i").alias("first"), (F.col("i") + 1).alias("last"))
    names = _frequent(words, "^[A-Z][a-z]+$", 5).select(F.lower("name").alias("key"))
    return mentions.without_common_words(found, words, names).select(F.col("item").alias("doc_id"), F.col("text").alias("word")).distinct()


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, i, text, follow): capitalised words and the word after each, cut from the text of one document, so that only they
    leave it. An id that several documents have is one sequence, as in the SQL: only its words are sorted in a window."""
    read, word = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")
    d = read.where("text IS NOT NULL")
    cap = word.between("A", "[") & word.rlike(r"^[A-Z][a-z]+\z")  # $ would let a line separator end the word

    def alone(d: DataFrame) -> DataFrame:
        w = d.select(F.col("doc_id").alias("item"), F.split("text", r"[ \t\n\r]+").alias("w"))
        rows = w.select("item", F.posexplode(F.arrays_zip(F.col("w").alias("text"), F.slice("w", 2, F.size("w")).alias("follow"))).alias("i", "x"))
        return rows.select("item", "i", "x.text", "x.follow").where(cap)

    repeated = read.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    if repeated.isEmpty():
        return alone(d)
    repeated, same = mentions.checked(repeated), F.col("doc_id").eqNullSafe(F.col("id"))
    words = _words_of(d.join(repeated, same, "left_semi"))
    follow = F.lead("text").over(Window.partitionBy("item").orderBy("i"))
    return alone(d.join(repeated, same, "left_anti")).unionByName(words.select("item", "i", "text", follow.alias("follow")).where(cap))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words as mentions with a label by place; every fourth with a capitalised word after it is a full name. They are
    written once, since queries read them several times and the texts are far larger."""
    pair = F.col("follow").rlike(r"^[A-Z][a-z]+\z") & (F.col("i") % 4 == 0)
    rows = store.Scratch(spark)(_followed(spark, sf_dir).withColumn("follow", F.when(pair, F.col("follow"))), "capitalised")
    full = F.col("follow").isNotNull()
    name = F.when(full, F.concat_ws(" ", "text", "follow")).otherwise(F.col("text"))
    label = F.when(full, "PERSON").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE", "ORG", "FAC")]), (F.col("i") % 5 + 1).cast("int")))
    none = F.lit(None).cast("string")
    return rows.select("item", F.lit("body").alias("segment_id"), F.lit(0).alias("sent"), F.col("i").alias("first"), (F.col("i") + F.when(full, 2).otherwise(1)).alias("last"), F.col("i").alias("start"), F.col("i").alias("end"), name.alias("text"), F.lower(name).alias("surface"), label.alias("label"), none.alias("canonical"), none.alias("entity_type"), none.alias("resolution"))


LABELLED = WORDS + ", " + CAPS + """, q AS (SELECT item, i, coalesce(regexp_matches(follow, '^[A-Z][a-z]+$'), false) AND i % 4 = 0 AS whole, text, follow FROM c WHERE regexp_matches(text, '^[A-Z][a-z]+$')),
m AS (SELECT item, i, CASE WHEN whole THEN text || ' ' || follow ELSE text END AS text, lower(CASE WHEN whole THEN text || ' ' || follow ELSE text END) AS surface, CASE WHEN whole THEN 'PERSON' ELSE ['PERSON', 'ORG', 'GPE', 'ORG', 'FAC'][i % 5 + 1] END AS label, whole FROM q)"""


@query(f"""WITH {LABELLED}, p AS (SELECT item, split_part(surface, ' ', 1) AS part FROM m WHERE whole UNION SELECT item, split_part(surface, ' ', 2) FROM m WHERE whole),
k AS (SELECT item, surface, count(*) FILTER (label = 'PERSON') AS p, count(*) FILTER (label = 'ORG') AS o, count(*) FILTER (label IN ('GPE', 'FAC')) AS l, count(DISTINCT label) AS k FROM m GROUP BY 1, 2),
won AS (SELECT k.item, k.surface, CASE WHEN p > 0 AND l > 0 AND k.surface NOT LIKE '% %' THEN CASE WHEN part IS NULL THEN 'GPE' ELSE 'PERSON' END WHEN p > 0 THEN 'PERSON' WHEN o > 0 AND l > 0 THEN CASE WHEN o >= l THEN 'ORG' ELSE 'GPE' END END AS won FROM k LEFT JOIN p ON k.item = p.item AND k.surface = p.part WHERE k.k > 1)
SELECT m.item AS doc_id, m.surface, CASE WHEN won IS NULL THEN label WHEN won = 'GPE' AND label IN ('GPE', 'FAC') THEN label WHEN won = 'PERSON' AND label = 'GPE' AND m.surface LIKE '% %' THEN label ELSE won END AS label, count(*) AS n FROM m LEFT JOIN won ON m.item = won.item AND m.surface = won.surface GROUP BY 1, 2, 3""")
def label_harmonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identity.harmonised(_labelled(spark, sf_dir))
    return got.groupBy(F.col("item").alias("doc_id"), "surface", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {LABELLED}, f AS (SELECT item, surface AS whole, max(text) AS canonical, split_part(surface, ' ', 1) AS one, split_part(surface, ' ', 2) AS two FROM m WHERE whole GROUP BY item, surface),
x AS (SELECT item, one AS surface, whole, canonical FROM f UNION SELECT item, two, whole, canonical FROM f), o AS (SELECT item, surface, count(DISTINCT whole) AS n, max(canonical) AS canonical FROM x GROUP BY 1, 2),
bare AS (SELECT DISTINCT item, surface FROM m WHERE NOT whole AND i % 5 IN (0, 1, 3) AND length(text) > 1)
SELECT bare.item AS doc_id, bare.surface, CASE WHEN n = 1 THEN canonical END AS canonical, CASE WHEN n IS NULL THEN 'own' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM bare LEFT JOIN o ON bare.item = o.item AND bare.surface = o.surface""")
def surname_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labelled(spark, sf_dir).where("label IN ('PERSON', 'ORG') AND length(text) > 1")
    names = spark.range(1).where(F.lit(False)).select(*[F.lit("").alias(c) for c in ("key", "canonical", "entity_type")])
    first = identity.looked_up(found, names)
    got, _ = identity.resolved(first, identity.name_index(first))
    state = F.when(F.col("entity_type").isNull(), "ambiguous").when(F.col("resolution") == "surname", "resolved").otherwise("own")
    bare = got.where("NOT surface LIKE '% %'").withColumn("state", state)
    return bare.select(F.col("item").alias("doc_id"), "surface", F.when(F.col("state") == "resolved", F.col("canonical")).alias("canonical"), "state").distinct()


@query("""WITH s AS (SELECT conv_id, turn, text, length(text) + 2 AS cost, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations WHERE text <> ''),
k AS (SELECT conv_id, least(length(text), 600 - spent) AS n, length(text) > 600 - spent AS cut FROM s WHERE spent < 600) SELECT conv_id, CAST(count(*) AS INT) AS n_segments, CAST(sum(n) + 2 * (count(*) - 1) AS INT) AS body_chars, bool_or(cut) AS truncated FROM k GROUP BY 1""")
def thread_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    got = c.select("conv_id", text.capped_segments(F.transform("s", lambda x: F.coalesce(x["text"], F.lit(""))), 600).alias("c"))
    return got.select("conv_id", F.size("c.kept").alias("n_segments"), F.length(F.array_join("c.kept", "\n\n")).alias("body_chars"), F.col("c.truncated").alias("truncated")).where("n_segments > 0")


@query("WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\r\\f\\v]+', ' ', 'g')) AS line FROM documents) SELECT doc_id, CAST(count(*) AS INT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE line <> '' GROUP BY 1")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return got.select("doc_id", F.size("l").alias("lines"), (F.length(F.array_join("l", "\n")) - F.size("l") + 1).cast("long").alias("chars"))


@query("""WITH d AS (SELECT *, CASE WHEN doc_id % 20 = 1 THEN 'blocked' WHEN doc_id % 20 IN (2, 3) THEN 'failed' WHEN n_chars <= 1000 AND doc_id % 20 = 4 THEN 'blocked' WHEN n_chars <= 1000 THEN 'skipped'
  WHEN doc_id % 20 = 5 THEN 'extraction_failed' WHEN doc_id % 20 = 6 THEN 'storage_failed' WHEN doc_id % 3 = 0 THEN 'stored_unchanged' ELSE 'stored_new' END AS o, doc_id % 20 NOT IN (1, 2, 3) AS was_read, n_chars > 1000 AND doc_id % 20 NOT IN (1, 2, 3) AS item FROM documents)
SELECT source, count(*) AS attempted, count(*) FILTER (was_read) AS fetched, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'blocked') AS blocked, count(*) FILTER (o = 'skipped') AS skipped,
count(*) FILTER (o = 'extraction_failed') AS extraction_failed, count(*) FILTER (o = 'storage_failed') AS storage_failed, count(*) FILTER (o = 'stored_new') AS stored_new, count(*) FILTER (o = 'stored_unchanged') AS stored_unchanged, count(*) FILTER (o LIKE 'stored%') AS stored,
CAST(coalesce(sum(CASE WHEN item THEN length(text) - length(replace(text, chr(10), '')) + 1 END), 0) AS BIGINT) AS segments, count(*) FILTER (item AND n_chars > 5000) AS truncated, 0::BIGINT AS missing_title, count(*) FILTER (item AND lang <> 'en') AS missing_author, count(*) FILTER (item) AS missing_published_at FROM d GROUP BY 1""")
def source_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tallies(_outcomes(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 20
    rows = d.select("*", F.when(k == 1, 403).when(k == 2, 500).otherwise(200).alias("status_code"), F.when(k == 3, F.concat(F.lit("timeout for https://h.example/p?token=x#y after "), F.col("doc_id") % 3, F.lit(" s: gave up"))).alias("error"))
    rows = rows.withColumn("was_read", ~k.isin(1, 2, 3)).withColumn("reason", F.when(F.col("was_read") & (F.col("n_chars") <= 1000), F.when(k == 4, "access_blocked: challenge").otherwise("empty_content: short")))
    rows = rows.withColumns({"extraction_error": F.when(k == 5, "x"), "storage_error": F.when(k == 6, "y"), "known": F.col("doc_id") % 3 == 0, "item": F.col("was_read") & F.col("reason").isNull()})
    rows = rows.withColumns({"outcome": reports.outcome(rows.columns), "segments": F.when(F.col("item"), F.size(F.split("text", "\n", -1))), "truncated": F.col("item") & (F.col("n_chars") > 5000), "title": F.lit("t"), "author": F.when(F.col("lang") == "en", "x"), "published_at": F.lit(None).cast("timestamp")})
    return rows.withColumn("reason", F.coalesce("reason", "error"))


@query("""SELECT source, CASE WHEN doc_id % 20 = 3 THEN 'failed' WHEN doc_id % 20 = 4 THEN 'blocked' ELSE 'skipped' END AS outcome,
CASE WHEN doc_id % 20 = 3 THEN 'timeout for https' WHEN doc_id % 20 = 4 THEN 'access_blocked' ELSE 'empty_content' END AS code, count(*) AS n FROM documents WHERE doc_id % 20 = 3 OR (n_chars <= 1000 AND doc_id % 20 NOT IN (1, 2, 3)) GROUP BY 1, 2, 3""")
def source_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reasons(_outcomes(spark, sf_dir))


@query(f"WITH {E1} SELECT source, target, relation_type, source_url, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM ev GROUP BY 1, 2, 3, 4")
def streaming_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = store.scratch(spark)
    schema = table(spark, sf_dir, "events").schema
    events = views.stream_of(spark, sf_dir, "events", schema)
    snapshots = store.Snapshots(spark, f"{at}/snapshots")
    into_snapshots(views.graph_of(events, 50, 10), snapshots, f"{at}/stream").awaitTermination()
    return snapshots.read("support").select("source", "target", "relation_type", "source_url", shown("first_seen"), shown("last_seen"))


@query(SQL["edge_weights"])
def incremental_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.events_graph(spark, sf_dir)
    support = None
    for k in range(3):  # three batches that share edges and urls
        support = store.ingest_observations(support, ev.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k))
    return store.edges_of(support).select("source", "target", "relation_type", "weight", shown("first_seen"), shown("last_seen"))
