"""Graph, store and text operators on hand-made graphs, and the queries against DuckDB."""

import datetime
from pathlib import Path

import duckdb
import pytest

from evigraph.functions import text, urls
from evigraph.operators import graph, store
from evigraph.plans import catalogue

DATA = "/root/testdata/sf0.001"
SINCE, AS_OF = datetime.datetime(2026, 10, 7, 12), datetime.datetime(2026, 10, 8, 12)
US = datetime.timedelta(microseconds=1)


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, "r", w) for i, (a, b, w) in enumerate(rows)], "id long, source string, target string, relation_type string, weight long")


def test_growth_table(spark):
    cases = [(0, 1), (1, 1), (2, 3), (6, 3), (10, 3), (10, 5), (3, 0)]
    rows = [(e, f"u{e}-{k}", SINCE - US if k < b else SINCE) for e, (b, a) in enumerate(cases) for k in range(b + a)]
    rows += [(0, "late", AS_OF + US), (2, "u2-0", SINCE)]
    o = spark.createDataFrame(rows, "edge_id long, source_url string, observed_at timestamp_ntz")
    got = graph.new_connections(o, SINCE, AS_OF, key=["edge_id"])
    assert {r.edge_id: r.reason for r in got.collect()} == {0: "new", 2: "grown", 3: "grown", 5: "grown"}
    at = lambda ratio: {r.edge_id for r in graph.new_connections(o, SINCE, AS_OF, min_ratio=ratio, key=["edge_id"]).collect()}
    assert 4 in at(0.3) and 4 not in at(0.30000000000000004)
    page = graph.growth_page(got, ["edge_id"], 100, 0)
    assert [r.edge_id for r in page.collect()] == [5, 2, 3, 0]


def test_bfs_and_selection(spark):
    e = edges(spark, [("A", "B", 1), ("C", "A", 1), ("B", "D", 1), ("C", "D", 1), ("D", "E", 1), ("A", "B", 1)])
    n = spark.createDataFrame([("A", 5), ("B", 1), ("C", 3), ("D", 2), ("E", 1), ("Z", 1)], "id string, mention_count long")
    nodes, kept, meta = graph.network(n, e, "A", 2)
    assert [(r.id, r.distance) for r in nodes.orderBy("place").collect()] == [("A", 0), ("C", 1), ("B", 1), ("D", 2)]
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 5] and meta["reason"] is None
    nodes, kept, meta = graph.network(n, e, "A", 2, max_nodes=2)
    assert [r.id for r in nodes.orderBy("place").collect()] == ["A", "C"] and [r.id for r in kept.collect()] == [1] and meta["reason"] == "max_nodes"
    with pytest.raises(ValueError):
        graph.distances(e, "A", 3)


def test_central_star(spark):
    e = edges(spark, [("H", "a", 1), ("H", "b", 1), ("c", "H", 3), ("x", "x", 9)])
    n = spark.createDataFrame([(i,) for i in "Habcx"], "id string")
    got = {r.id: r for r in graph.central(n, e).collect()}
    assert (got["H"].degree, got["H"].weighted_degree, got["H"].score) == (3, 5, 0.75) and got["x"].degree == 0
    assert graph.central(n.limit(0), e.limit(0)).count() == 0


def test_resolution(spark):
    n = spark.createDataFrame([(1, "alice example"), (2, "alice other")], "id long, normalized_name string")
    a = spark.createDataFrame([("alice", 1), ("alice", 2), ("@al", 1)], "alias_key string, node_id long")
    assert graph.resolve_entity(n, a, " @AL ")["id"] == 1 and graph.resolve_entity(n, a, "Alice", 2)["id"] == 2
    with pytest.raises(graph.AmbiguousEntity):
        graph.resolve_entity(n, a, "alice")
    with pytest.raises(graph.EntityNotFound):
        graph.resolve_entity(n, a, "nobody")


def test_snapshots_and_ids(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(f"k{i:02d}",) for i in range(30)], "key string")
    assert s.version == 0 and s.publish("1", nodes=store.with_ids(rows, 100, ["key"])) == 1
    got = sorted((r.id, r.key) for r in s.read("nodes").collect())
    assert got == [(101 + i, f"k{i:02d}") for i in range(30)]


def test_urls_and_names():
    assert urls.canonical("HTTP://Example.COM:80/a?utm_x=1&b=2&a=1#f") == "http://example.com/a?a=1&b=2"
    assert all(urls.canonical(u) is None for u in ("ftp://a.b", "http://u:p@a.b", "http://10.0.0.1", "http://localhost", "http://a.b:81", None, "http://x.local"))
    assert text.normalize_name("  ＡlICE  Straße ") == "alice strasse"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_queries_equal_duckdb(spark):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        mine = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
        got = con.execute(sql).df()
        theirs = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
        assert sorted(got.columns) == cols and mine == sorted(map(str, theirs)), name


def test_words_stay_in_their_documents(spark, tmp_path):
    same = "Ann Lee met Bo and Lee . Then Bo Kim left"
    docs = [(1, "Ann Lee saw Lee . Ann , Kim and Bo Lee met Kim"), (2, "Ann  Lee Ann Lee\x85 Kim"), (3, same), (3, same), (None, same), (None, same), (4, None), (5, ""), (6, "Ann"), (7, " Ann\n\tLee  Lee Ann Zed Lee A Ann Lee")]

    def rows(docs, name):
        at = tmp_path / f"{name}-{len(docs)}"
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
        df = catalogue.queries()[name](spark, str(at))
        theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        return df._jdf.queryExecution().toString(), sorted(map(str, map(tuple, df.collect()))), sorted(map(str, theirs))

    for name in ("surname_resolution", "label_harmonise"):
        for some in (docs, [x for x in docs if x[0] not in (3, None)]):  # with and without ids that repeat
            plan, mine, theirs = rows(some, name)
            assert mine == theirs and mine, name
            assert "Window " not in plan and "posexplode" not in plan, name  # texts are cut once, before the joins
