"""The given tables as observations, graphs, sentences and threads, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_of(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:  # type: ignore[no-untyped-def]
    """A table as a file stream; one that is a single file is found by name in its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def graph_of(e: DataFrame, people: int, topics: int) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("PERSON:user-"), F.col("user_id") % people).alias("source"), F.concat(F.lit("TOPIC:k-"), k % topics).alias("target"), F.col("event_type").alias("relation_type"), F.to_date("ts").cast("string").alias("source_url"), F.col("ts").alias("observed_at"))


def events_graph(spark: SparkSession, sf_dir: str, people: int = 50, topics: int = 10) -> DataFrame:
    """People and topics folded to a dense graph of observations."""
    return graph_of(table(spark, sf_dir, "events"), people, topics)


E1 = """ev AS (SELECT event_id AS id, 'PERSON:user-' || (user_id % 50) AS source, 'TOPIC:k-' || (CAST(json_extract(props, '$.k') AS INT) % 10) AS target,
  event_type AS relation_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS source_url, ts AS observed_at FROM events)"""


def purchases_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of purchases, sparse enough for neighbourhoods."""
    from ..operators.graph import edge_weights

    o = events_graph(spark, sf_dir, 1 << 40, 1000).where("relation_type = 'purchase'")
    edges = edge_weights(o).withColumn("id", F.concat_ws("|", "source", "target", "relation_type"))
    ends = o.select(F.col("source").alias("id"), "source_url").unionAll(o.select("target", "source_url"))
    nodes = ends.groupBy("id").agg(F.count_distinct("source_url").alias("mention_count"))
    return nodes, edges


E2 = """ev AS (SELECT 'PERSON:user-' || user_id AS source, 'TOPIC:k-' || CAST(json_extract(props, '$.k') AS INT) AS target,
  event_type AS relation_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS source_url, ts AS observed_at FROM events WHERE event_type = 'purchase'),
edges AS (SELECT source, target, relation_type, count(DISTINCT source_url) AS weight, source || '|' || target || '|' || relation_type AS id FROM ev GROUP BY 1, 2, 3),
nodes AS (SELECT id, count(DISTINCT source_url) AS mention_count FROM (SELECT source AS id, source_url FROM ev UNION ALL SELECT target, source_url FROM ev) GROUP BY 1)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: orders as sentences, brands as entities."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.col("p_brand").alias("entity")), "p_partkey").select("item", "entity")


B1 = "b AS (SELECT DISTINCT l_orderkey AS item, p_brand AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)"
