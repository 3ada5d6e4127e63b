"""Configuration, frontier, store, reports, a whole ingest, API and CLI."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from evigraph import cli
from evigraph.api import Service, serve
from evigraph.functions import urls
from evigraph.operators import frontier, graph, integrity, reports, store
from evigraph.plans.ingest import graph_problems, ingest
from evigraph.sources.config import ConfigError, Settings, parse_config, parse_vocabulary

UTC = datetime.UTC
SOURCE = {"name": "news", "source_type": "news", "adapter": "article", "seeds": ["https://n.example/list", "https://n.example/a/1"], "allowed_domains": ["N.example."], "include_paths": ["^/a/"], "listing_paths": ["^/list$"], "follow_links": "listings"}
SECOND = {"name": "talk", "source_type": "discussion", "adapter": "forum", "seeds": ["https://t.example/"], "allowed_domains": ["t.example"], "max_depth": 0}
ENTITIES = {"entities": [{"canonical": "Elon Musk", "type": "PERSON", "handles": ["@elonmusk"]}, {"canonical": "United Nations", "type": "ORG", "aliases": ["UN"]}, {"canonical": "Delhi", "type": "LOCATION"}, {"canonical": "Narendra Modi", "type": "PERSON"}]}


def test_config():
    c = parse_config({"crawl": {"max_depth": 2}, "sources": [SOURCE, SECOND]})
    assert c.sources[0].allowed_domains == ("n.example",) and c.depth_limit(c.sources[1]) == 0 and c.depth_limit(c.sources[0]) == 2 and c.delay(c.sources[0]) == 2
    assert c.source_for("https://N.example/a/9?utm_source=x").name == "news" and c.source_for("https://n.example/other") is None
    for change in ({"name": "Bad Name"}, {"adapter": "none"}, {"seeds": []}, {"seeds": ["https://other.example/"]}, {"allowed_domains": ["https://n.example"]}, {"include_paths": ["("]}, {"include_paths": ["x" * 201]}, {"max_depth": 9}, {"min_delay_seconds": 500}, {"unknown": 1}, {"follow_links": "none"}, {"seeds": ["ftp://n.example/a/1"]}):
        with pytest.raises(ConfigError):
            parse_config({"sources": [{**SOURCE, **change}]})
    for crawl in ({"max_pages_total": 0}, {"max_pages_per_source": 1}, {"max_depth": True}, {"max_pages_total": 2}):
        with pytest.raises(ConfigError):
            parse_config({"crawl": crawl, "sources": [SOURCE, SECOND]})
    with pytest.raises(ConfigError):
        parse_config({"sources": [SOURCE, SOURCE]})
    assert Settings.from_env({"EVIGRAPH_GROWTH_MIN_DELTA": "5"}).growth_min_delta == 5
    with pytest.raises(ValueError):
        Settings.from_env({"EVIGRAPH_GROWTH_MIN_RATIO": "0"})


CASES = [
    ("http://A.example.com:80?b=2&a=1&utm_x=3&FBCLID=1#f", "http://a.example.com/?a=1&b=2"), ("https://u:p@h.example/", None), ("http://10.0.0.1/", None), ("http://[::1]/x", None), ("https://ex.example:443", "https://ex.example/"),
    ("https://ex.example:8080/", None), ("http://bücher.example/ä?q=a b*~", "http://xn--bcher-kva.example/ä?q=a+b%2A~"), ("ftp://x.example", None), ("https://x.local/", None), ("https://localhost/", None), ("http://8.8.8.8/a", "http://8.8.8.8/a"),
    (" https://x.example./p?x&y= ", "https://x.example/p?x=&y="), ("https://x.example:99999/", None), (None, None), ("", None), ("no url", None), ("http://x.example:443/", "http://x.example:443/"), ("https://x.example/a?b=%20c&a=%2F", "https://x.example/a?a=%2F&b=+c"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)], "i int, u string")
    got = {r.i: r.c for r in df.select("i", urls.canonical_urls(F.col("u")).alias("c")).collect()}
    for i, (u, want) in enumerate(CASES):
        assert urls.canonical(u) == want and got[i] == want, u
    safe = [("https://u:p@H.example:81/x?token=1#y", "https://h.example:81/x"), ("https://p@ss@h.example/", "https://h.example/"), ("ftp://h.example/f?q", "ftp://h.example/f"), ("http://h.example:abc/", "<invalid url>"), ("http://h.example:99999/", "<invalid url>"), ("https://[::1]:80/x", "https://[::1]:80/x"), ("/path?q=1", "/path")]
    rows = spark.createDataFrame(safe, "u string, want string").select(urls.safe_url(F.col("u")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    pairs = [("reddit", "https://old.reddit.com/r/A/comments/Bc/t/?x=1"), ("hackernews", "https://news.ycombinator.com/item?p=2&id=7"), ("article", "https://a.example/r/A/comments/b/")]
    rows = spark.createDataFrame(pairs, "a string, u string").select("a", "u", urls.thread_url(F.col("a"), F.col("u")).alias("t")).collect()
    assert [r.t for r in rows] == [urls.thread_of(r.a, r.u) for r in rows] == ["https://www.reddit.com/r/a/comments/bc/", "https://news.ycombinator.com/item?id=7", pairs[2][1]]
    text = spark.createDataFrame([("see https://a.example/x?tok=1#f  now",)], "t string")
    assert text.select(urls.scrubbed(F.col("t"))).first()[0] == "see https://a.example/x now"


def test_frontier(spark):
    c = parse_config({"crawl": {"max_depth": 2}, "sources": [SOURCE, SECOND]})
    p = c.frame(spark)
    links = spark.createDataFrame([("https://n.example/list", 0, "https://n.example/a/1"), ("https://n.example/list", 1, "https://n.example/a/2#x"), ("https://n.example/list", 2, "https://elsewhere.example/"), ("https://n.example/list", 3, "http://10.0.0.1/"), ("https://n.example/list", 4, "https://n.example/list"), ("https://n.example/a/1", 0, "https://n.example/a/3"), ("https://t.example/", 0, "https://t.example/deeper")], "page_url string, pos int, link string")
    got = [(r.link, r.depth, r.source, r.reason) for r in frontier.expand(p, links, 2).orderBy("depth", "id").collect()]
    assert [g for g in got if g[3] is None] == [("https://n.example/list", 0, "news", None), ("https://t.example/", 0, "talk", None), ("https://n.example/a/1", 0, "news", None), ("https://n.example/a/2#x", 1, "news", None)]
    assert {(g[0], g[3]) for g in got if g[3]} == {("https://n.example/a/1", "duplicate_url"), ("https://elsewhere.example/", "outside_source_policy"), ("http://10.0.0.1/", "invalid_url"), ("https://n.example/list", "listing_not_seed"), ("https://n.example/a/3", "links_not_followed"), ("https://t.example/deeper", "depth_limit")}
    queue = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(10)], "id long, source string")
    assert [r.reason for r in frontier.budgeted(queue, 3, 5).orderBy("id").collect()] == [None] * 3 + ["source_page_limit"] * 3 + [None] * 2 + ["total_page_limit"] * 2
    pages = spark.createDataFrame([(1, "https://n.example/a/5", "news"), (2, "https://evil.example/a/5", "news"), (3, "https://n.example/list", "news")], "id long, final_url string, source string")
    assert [r.error for r in frontier.redirected(pages, p).orderBy("id").collect()] == [None, "Redirect left source policy", None]
    assert [r.is_listing for r in frontier.listings(pages, p, "final_url").orderBy("id").collect()] == [False, False, True]


def test_ids_are_dense_at_scale(spark):
    new = spark.range(1_500_000).select((F.col("id") * 7919 % 1_500_007).alias("k"), F.lit("x").alias("extra"))
    got = store.with_ids(new, 100, ["k"]).agg(F.count_distinct("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("z")).first()
    assert (got.n, got.a, got.z) == (1_500_000, 101, 1_500_100)
    ties = spark.createDataFrame([(None,)] * 3 + [(5,)] * 4, "k long")
    assert sorted(r.id for r in store.with_ids(ties, 0, ["k"]).collect()) == list(range(1, 8)) and store.with_ids(ties.limit(0), 0, ["k"]).count() == 0


def test_store_pieces(spark):
    m = spark.createDataFrame([(1, "PERSON:ann", "PERSON", "Ann", "Ann", "s", 0, 3, "exact", 1), (1, "PERSON:ann", "PERSON", "Ann", "@ann", "s", 9, 12, "Handle", 2), (1, "PERSON:ann", "PERSON", "Ann", "ann", "s", 0, 3, "surname", 3)], "item long, key string, entity_type string, canonical_name string, name string, segment_id string, start int, end int, resolution string, ord int")
    assert [(r.name, r.occurrence_count, r.surface_forms) for r in store.collect_nodes(m).collect()] == [("Ann", 2, ["@ann", "Ann", "ann"])]
    assert {(r.alias_key, r.alias_kind) for r in store.mention_aliases(m).collect()} == {("ann", "surname"), ("@ann", "handle")}
    assert store.key_faults(m).count() == 0 and store.key_faults(m.withColumn("key", F.lit("PERSON:bob"))).count() == 3
    r = spark.createDataFrame([(1, "a", "b", "s", 0, 2, "te", "met", "r"), (1, "a", "c", "s", 0, 2, "te", "met", "r"), (1, "a", "a", "s", 0, 2, "te", "met", "r"), (1, "a", "b", "s", 2, 2, "", "met", "r"), (1, "a", "b", "s", 0, 9, "text", "met", "r"), (1, "a", "b", "s", 0, 2, "te", " ", "r")], "item long, source_key string, target_key string, segment_id string, start int, end int, evidence_text string, relation_type string, rule_id string")
    nodes, seg = spark.createDataFrame([(1, "a"), (1, "b")], "item long, key string"), spark.createDataFrame([(1, "s", "text")], "item long, segment_id string, text string")
    assert sorted(x.status for x in store.checked_relations(r, nodes, seg).collect()) == ["invalid_evidence"] * 3 + ["ok", "relations_skipped", "self_edges_rejected"]
    edges = spark.createDataFrame([(5, 2, "met", False), (5, 2, "hit", True)], "source_node_id long, target_node_id long, relation_type string, directed boolean")
    assert {(x.source_node_id, x.target_node_id) for x in store.canonical_ends(edges).collect()} == {(2, 5), (5, 2)}
    assert store.direction_conflicts(edges.unionByName(edges.withColumn("directed", ~F.col("directed")))).count() == 2


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/g")
    assert s.version == 0 and s.publish("v1", a=spark.range(3), b=spark.range(1)) == 1
    old = s.pinned()
    assert s.publish("v2", a=spark.range(5)) == 2 and s.read("a").count() == 5 and s.read("b").count() == 1 and old.read("a").count() == 3 and s.tables() == ["a", "b"]
    other = store.Snapshots(spark, f"file://{tmp_path}/g")
    path, fs = other._fs()
    fs.create(path(f"{other.path}/v=3/_claim"), False).close()
    with pytest.raises(store.Conflict):
        s.publish("v3", a=spark.range(1))
    s.abandon(3)
    assert s.publish("v3", schema_version=99, a=spark.range(1)) == 3
    with pytest.raises(RuntimeError):
        s.read("a")
    with pytest.raises(RuntimeError):
        s.migrate()
    assert s.publish("v0", schema_version=0, a=spark.range(2)) == 4
    s.MIGRATIONS[0] = lambda tables: {**tables, "c": tables["a"]}
    assert s.migrate() == 5 and s.read("c").count() == 2
    del s.MIGRATIONS[0]


def test_resolution_beyond_a_page(spark):
    nodes = spark.createDataFrame([(i, f"N{i}", "same", "ORG", 1) for i in range(150)], "id long, name string, normalized_name string, entity_type string, mention_count long")
    none = spark.createDataFrame([], "alias_key string, node_id long")
    assert graph.resolve_entity(nodes, none, "Same", 140)["id"] == 140
    with pytest.raises(graph.AmbiguousEntity):
        graph.resolve_entity(nodes, none, "same")
    for bad in ({"min_ratio": 0}, {"min_delta": 0}, {"since": 5, "as_of": 4}):
        with pytest.raises(ValueError):
            graph.new_connections(nodes, **{"since": 1, "as_of": 2, **bad})


def test_reports(spark):
    rows = [("empty_content: a page", "empty_content"), ("see https://x.example/p?q=1 then", "see https://x.example/p then"), ("", "unknown"), ("Unexpected error in _crawl_web\nlong\nnet::ERR at https://x.example/p?q=1", "crawl_failed: net::ERR at <url>")]
    got = spark.createDataFrame(rows, "reason string, want string").select(reports.reason_code().alias("got"), "want").collect()
    assert [r.got for r in got[1:]] == [r.want for r in got[1:]][:0] + ["see https", "unknown", "crawl_failed: net::ERR at <url>"] and got[0].got == "empty_content"
    kinds = [("Ambiguous surname 'X' left: Y", "Ambiguous surname"), ("Skipped a  sentence with 9 entities", "Skipped a sentence"), ("Time unread: x", "Time unread"), ("No rule for this", "No rule"), ("with nine", "with nine")]
    got = spark.createDataFrame(kinds, "warning string, want string").select(reports.warning_kind().alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert [reports.run_status(*x) for x in ((True, 0, 0, 0), (False, 1, 0, 0), (False, 0, 0, 0))] == [("failed", 1), ("partial", 3), ("complete", 0)]


def test_constraints(spark):
    edges = spark.createDataFrame([(1, 1, 2, "met", False, 1, 5, 6), (2, 2, 1, "met", False, 0, 5, 4), (3, 1, 1, "", True, 1, 5, 5), (4, 1, 2, "met", True, None, 5, 5)], "id long, source_node_id long, target_node_id long, relation_type string, directed boolean, weight long, first_seen int, last_seen int")
    got = {r.check: r.violations for r in integrity.constraints({"edges": edges}).collect() if r.violations}
    assert got == {"edge_relation": 1, "edge_weight": 1, "edge_self": 1, "edge_ends": 1, "edge_order": 1, "edges_weight_missing": 1, "edges_unique": 1}


def fetched(spark, rows):
    return spark.createDataFrame(rows, "requested_url string, final_url string, source_name string, depth int, fetched_at timestamp, success boolean, status_code int, html string, error string")


def page(text):
    return f"<article><p>{text}</p><p>{'More words follow here. ' * 8}</p></article>"


def test_ingest_api_and_cli(spark, tmp_path, monkeypatch, capsys):
    config, vocabulary = parse_config({"sources": [SOURCE, SECOND]}), parse_vocabulary(ENTITIES, {"topics": [{"name": "trade", "patterns": ["tariffs"]}]})
    s = store.Snapshots(spark, f"file://{tmp_path}/g")
    t = lambda d: datetime.datetime(2026, 1, d, tzinfo=UTC)
    first = [("https://n.example/a/1", "https://n.example/a/1", "news", 0, t(1), True, 200, page("Elon Musk met Narendra Modi in Delhi. Later Musk criticized the UN. @elonmusk posted on tariffs."), None), ("https://n.example/list", "https://n.example/list", "news", 0, t(1), True, 200, "<p>short</p>", None), ("https://t.example/", "https://t.example/", "talk", 0, t(1), False, None, None, "timeout")]
    report = ingest(spark, fetched(spark, first), config, vocabulary, s, 1, t(2))
    assert report["status"] == "partial" and report["graph"]["nodes"] == 5 and report["graph"]["edges"] == 5 and report["integrity"]["ok"] and report["missing_sources"] == ["talk"]
    assert report["sources"]["news"]["stored_new"] == 1 and report["skip_reasons"]["failed"] == {"timeout": 1} and graph_problems(s) == []
    again = [*first[:1], (*first[0][:4], t(3), True, 200, page("Elon Musk left Delhi."), None)]
    report = ingest(spark, fetched(spark, again), config, vocabulary, s, 2, t(4))
    assert report["sources"]["news"]["stored_unchanged"] == 1 and report["sources"]["news"]["stored_new"] == 1 and report["graph"]["sources"] == 2 and report["graph"]["nodes"] == 5 and report["integrity"]["ok"]
    edges = {(r.source_node_id, r.target_node_id): r.weight for r in s.read("edges").collect()}
    assert set(edges.values()) == {1} and s.read("nodes").agg(F.count_distinct("id")).first()[0] == 5
    assert {c: n for c, n in ((r.check, r.violations) for r in integrity.constraints({x: s.read(x) for x in ("nodes", "edges", "edge_sources", "node_aliases")}).collect()) if n} == {}
    assert s.read("crawl_runs").where("status = 'running'").count() == 0 and report["extractor_version"].startswith("rules-")

    api = Service(s, now=lambda: t(9))
    status, body = api.answer("/entity/%40elonmusk/network?depth=1")
    assert status == 200 and body["root"]["name"] == "Elon Musk" and {n["name"] for n in body["nodes"]} == {"Elon Musk", "Narendra Modi", "Delhi", "United Nations", "trade"} and not body["truncated"]
    status, body = api.answer("/connections/new?since=2026-01-01T00:00:00%2B00:00&limit=2")
    assert status == 200 and body["total"] == 5 and len(body["items"]) == 2 and body["items"][0]["reason"] == "new"
    edge = body["items"][0]["edge_id"]
    status, body = api.answer(f"/edges/{edge}/sources")
    assert status == 200 and body["total"] == len(body["items"]) == 1 and body["items"][0]["segment_kind"] == "body" and body["items"][0]["evidence_text"]
    assert api.answer("/entities/central?limit=1")[1]["items"][0]["name"] == "Elon Musk" and api.answer("/health")[1]["graph"]["nodes"] == 5
    for target, code in (("/entity/nobody/network", 404), ("/entity/x/network?depth=3", 422), ("/connections/new?since=2026-01-01", 422), ("/connections/new", 422), ("/edges/999/sources", 404), ("/edges/x/sources", 422), ("/none", 404)):
        status, body = api.answer(target)
        assert status == code and body["error"]["code"] and body["error"]["request_id"], target
    server = serve(api, port=0)
    server.server_close()

    (tmp_path / "c.toml").write_text("[[sources]]\n" + "\n".join(f"{k} = {json.dumps(v)}" for k, v in SOURCE.items()))
    (tmp_path / "aliases.toml").write_text('[[entities]]\ncanonical = "Delhi"\ntype = "LOCATION"\n')
    (tmp_path / "topics.toml").write_text('[[topics]]\nname = "trade"\npatterns = ["tariffs"]\n')
    fetched(spark, first[:1]).write.parquet(f"{tmp_path}/pages")
    monkeypatch.setenv("EVIGRAPH_STORE_PATH", f"file://{tmp_path}/cli")
    monkeypatch.setenv("EVIGRAPH_REPORT_DIR", f"file://{tmp_path}/reports")
    config_args = ["--config", str(tmp_path / "c.toml")]
    assert cli.main(["validate-config", *config_args]) == 0 and json.loads(capsys.readouterr().out)["seeds"] == 2
    assert cli.main(["probe", *config_args, "--pages", f"{tmp_path}/pages"], spark) == 0
    assert cli.main(["ingest", *config_args, "--pages", f"{tmp_path}/pages"], spark) == 0
    assert list((tmp_path / "reports").glob("run-*/report.json")) and cli.main(["validate-config", "--config", str(tmp_path / "none.toml")]) == 2 and cli.main(["no-command"]) == 2
