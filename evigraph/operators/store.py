"""The write path: versions, keyed upserts, derived counts, and immutable snapshots of the tables.

A snapshot is a folder v=N with one Parquet table each; a batch makes the next one from the last and is published by
writing its marker table, so a reader sees all of a batch or nothing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_names
from .cooccurrence import first_wins

SCHEMA_VERSION = 1
ALIAS_KINDS = ["handle", "abbreviation", "alias", "surname", "surface"]
RUN = "id long, started_at timestamp, finished_at timestamp, status string, config_hash string, extractor_version string, summary_json string"
RELATION_KEY = ["source_key", "target_key", "relation_type"]


def content_hash(title: str = "title", body: str = "body", segments: str = "segments") -> F.Column:
    """A stable hash of what makes a version; times and metadata don't count."""
    return F.sha2(F.to_json(F.struct(F.col(title).alias("title"), F.col(body).alias("body"), F.col(segments).alias("segments")), {"ignoreNullFields": "false"}), 256)


def new_versions(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items whose (source_url, content_hash) isn't stored, once each; the first of a batch wins."""
    return first_wins(items, ["source_url", "content_hash"], ["scraped_at", "ord"]).join(sources, ["source_url", "content_hash"], "left_anti")


def refreshed(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Stored versions seen again move last_scraped_at on, nothing else."""
    seen = items.groupBy("source_url", "content_hash").agg(F.max("scraped_at").alias("_seen"))
    return sources.join(seen, ["source_url", "content_hash"], "left").withColumn("last_scraped_at", F.greatest("last_scraped_at", F.coalesce("_seen", "last_scraped_at"))).drop("_seen").select(*sources.columns)


def refreshed_edges(edges: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """last_seen of edges moves on with the last_scraped_at of the versions that support them."""
    seen = evidence.select(F.col("edge_id").alias("id"), "source_id").join(sources.select(F.col("id").alias("source_id"), "last_scraped_at"), "source_id").groupBy("id").agg(F.max("last_scraped_at").alias("_seen"))
    return edges.join(seen, "id", "left").withColumn("last_seen", F.greatest("last_seen", F.coalesce("_seen", "last_seen"))).select(*edges.columns)


def with_ids(new: DataFrame, last_id: int, order: list[str], id_col: str = "id", parts: int = 64) -> DataFrame:
    """Ids after the last one, in the order of columns. Only new keys are numbered.

    Rows fall into ranges between bounds from a sample of the order's values; a row's range depends on its own values
    only, so both readings of `new` agree on it. Places inside a range are added to the counts of the ranges before."""
    key = F.struct(*order)
    n = new.count()
    sample = new.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(1 + n // 2000)) == 0).distinct().orderBy(*order).limit(8000).collect()  # a bounded sample
    kinds = [new.schema[c].dataType for c in order]
    bounds = [sample[k * len(sample) // parts] for k in range(1, parts)] if len(sample) > parts else []
    array = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, kinds, order, strict=True)]) for r in bounds])
    of = F.size(F.filter(array, lambda b: b < key)) if bounds else F.lit(0)
    rows = new.withColumn("_p", of)
    before = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_k", own).join(F.broadcast(before), "_p").withColumn(id_col, (F.col("_b") + F.col("_k") + last_id).cast("long")).drop("_p", "_b", "_k")


def key_faults(mentions: DataFrame) -> DataFrame:
    """Mentions whose key isn't that of their type and canonical name; none may be stored."""
    key = F.concat_ws(":", "entity_type", normalized_names(F.col("canonical_name")))
    return mentions.where(~F.col("key").eqNullSafe(key) | (normalized_names(F.col("canonical_name")) == ""))


def collect_nodes(mentions: DataFrame) -> DataFrame:
    """Per item and key the first canonical name, spans and surfaces. mentions: item, key, entity_type, canonical_name, name, segment_id, start, end, ord."""
    plain = F.trim(F.regexp_replace("canonical_name", r"(?U)\s+", " "))
    return mentions.groupBy("item", "key").agg(F.min_by(plain, "ord").alias("name"), F.min_by("entity_type", "ord").alias("entity_type"), F.count_distinct("segment_id", "start", "end").alias("occurrence_count"), F.array_sort(F.collect_set(F.when(F.trim("name") != "", F.col("name")))).alias("surface_forms"))


def mention_aliases(mentions: DataFrame) -> DataFrame:
    """(item, key, alias_key, alias_kind) of written names, each with its best kind."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ALIAS_KINDS]), alias_kind())
    rows = mentions.select("item", "key", normalized_names(F.col("name")).alias("alias_key"), alias_kind().alias("alias_kind"), rank.alias("_r"))
    return rows.where("alias_key != ''").groupBy("item", "key", "alias_key").agg(F.min_by("alias_kind", "_r").alias("alias_kind"))


def alias_kind(resolution: str = "resolution") -> F.Column:
    """What kind of alias a resolution makes: the first kind in order that its text holds, case aside."""
    text = F.lower(F.col(resolution))
    return F.coalesce(*[F.when(text.contains(k), k) for k in ALIAS_KINDS[:-1]], F.lit(ALIAS_KINDS[-1]))


def best_aliases(aliases: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per (alias_key, node_id), reviewed ones first, then by kind; stored ones stay as they are."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ALIAS_KINDS]), F.col("alias_kind"))
    best = first_wins(aliases.withColumn("_r", (F.col("origin") != "reviewed").cast("int")).withColumn("_k2", rank), ["alias_key", "node_id"], ["_r", "_k2"]).drop("_r", "_k2")
    return best.join(stored, ["alias_key", "node_id"], "left_anti")


def checked_relations(relations: DataFrame, nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds `status`: relations_skipped, self_edges_rejected, invalid_evidence or ok, in this order of checks."""
    known = nodes.select("item", "key")
    r = relations.join(known.select("item", F.col("key").alias("source_key"), F.lit(True).alias("_s")), ["item", "source_key"], "left")
    r = r.join(known.select("item", F.col("key").alias("target_key"), F.lit(True).alias("_t")), ["item", "target_key"], "left")
    r = r.join(segments.select("item", "segment_id", F.col("text").alias("_text")), ["item", "segment_id"], "left")
    cut = F.expr("substring(_text, start + 1, end - start)")
    blank = reduce(Column.__or__, [F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == "" for c in ("evidence_text", "relation_type", "rule_id")])
    status = (
        F.when(F.col("_s").isNull() | F.col("_t").isNull(), "relations_skipped")
        .when(F.col("source_key") == F.col("target_key"), "self_edges_rejected")
        .when(F.col("_text").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("_text")) | ~cut.eqNullSafe(F.col("evidence_text")) | blank, "invalid_evidence")
        .otherwise("ok")
    )
    return r.withColumn("status", status).drop("_s", "_t", "_text")


def canonical_ends(edges: DataFrame, source: str = "source_node_id", target: str = "target_node_id") -> DataFrame:
    """Undirected edges run from the smaller to the larger id."""
    a, b = F.when(F.col("directed"), F.col(source)).otherwise(F.least(source, target)), F.when(F.col("directed"), F.col(target)).otherwise(F.greatest(source, target))
    return edges.withColumns({source: a, target: b})


def direction_conflicts(edges: DataFrame) -> DataFrame:
    """Relation keys stored with both directions."""
    return edges.groupBy("source_node_id", "target_node_id", "relation_type").agg(F.count_distinct("directed").alias("n")).where("n > 1")


def merged(stored: DataFrame, new: DataFrame, key: list[str], sums: list[str] = (), least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """A keyed upsert as one aggregate over old and new rows."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in greatest]
    return stored.unionByName(new).groupBy(*key).agg(*aggs)


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the one that driver and executors share: spark.checkpoint.dir, a temporary one only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='evigraph-')).rstrip('/')}/evigraph-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables: written once and read again, which survives lost executors and keeps plans short."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, scratch(spark)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Snapshots:
    """Versions of named tables under one folder.

    A version's marker table says in which version each table was written last, so a batch writes only what it changes.
    A writer claims its version by creating a file that must not exist, so of two writers one fails and may try again."""

    #: Steps from a schema version to the next, each a function of the tables by name.
    MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {}

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.pin = spark, path.rstrip("/"), version

    def _fs(self):  # type: ignore[no-untyped-def]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _published(self) -> list[int]:
        path, fs = self._fs()
        root = path(self.path)
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(path(p, "_meta/_SUCCESS")))

    @property
    def version(self) -> int:
        return self.pin or max(self._published(), default=0)

    def pinned(self) -> Snapshots:
        """A reader that stays at the version of now."""
        return Snapshots(self.spark, self.path, self.version)

    def meta(self, version: int | None = None) -> Row:
        return self.spark.read.parquet(f"{self.path}/v={version or self.version}/_meta").first()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        meta = self.meta(version)
        if meta.schema_version != SCHEMA_VERSION:
            raise RuntimeError(f"snapshot schema {meta.schema_version}, this engine has {SCHEMA_VERSION}")
        return self.spark.read.parquet(f"{self.path}/v={meta.tables[table]}/{table}")

    def tables(self) -> list[str]:
        return sorted(self.meta().tables) if self.version else []

    def publish(self, extractor_version: str, schema_version: int = SCHEMA_VERSION, **tables: DataFrame) -> int:
        old = self.version
        v = old + 1
        path, fs = self._fs()
        try:
            fs.create(path(f"{self.path}/v={v}/_claim"), False).close()
        except Py4JJavaError as e:
            raise Conflict(f"version {v} is being written by another run") from e
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v={v}/{name}")
        where = {**(self.meta(old).tables if old else {}), **dict.fromkeys(tables, v)}
        meta = self.spark.createDataFrame([(schema_version, extractor_version, where)], "schema_version int, extractor_version string, tables map<string,int>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={v}/_meta")
        return v

    def abandon(self, version: int) -> None:
        """Frees a version that its writer left unpublished."""
        path, fs = self._fs()
        if version not in self._published():
            fs.delete(path(f"{self.path}/v={version}"), True)

    def migrate(self) -> int:
        """Brings the newest snapshot to this engine's schema step by step; a newer one is refused. A step that fails
        publishes nothing."""
        meta = self.meta()
        if meta.schema_version > SCHEMA_VERSION:
            raise RuntimeError(f"snapshot schema {meta.schema_version} is newer than {SCHEMA_VERSION}")
        tables = {t: self.spark.read.parquet(f"{self.path}/v={v}/{t}") for t, v in meta.tables.items()}
        for step in range(meta.schema_version, SCHEMA_VERSION):
            tables = self.MIGRATIONS[step](tables)
        return self.version if meta.schema_version == SCHEMA_VERSION else self.publish(meta.extractor_version, **tables)


def start_run(runs: DataFrame | None, spark: SparkSession, run_id: int, started_at, config_hash: str, extractor_version: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """The runs table with a running run."""
    row = spark.createDataFrame([(run_id, started_at, None, "running", config_hash, extractor_version, None)], RUN)
    return row if runs is None else runs.unionByName(row)


def finish_run(runs: DataFrame, run_id: int, finished_at, status: str, summary: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """Closes a run as complete, partial or failed."""
    if status not in ("complete", "partial", "failed"):
        raise ValueError(f"no status {status!r}")
    own = F.col("id") == run_id
    done = {"finished_at": F.lit(finished_at), "status": F.lit(status), "summary_json": F.lit(summary)}
    return runs.select(*[F.when(own, done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in runs.columns])


def extractor_version(rules: str, annotator: str, *vocabularies: bytes) -> str:
    """Names the rules, the annotator and the vocabularies that made a graph."""
    return f"{rules}+{annotator}+cfg-{hashlib.sha256(bytes(1).join(vocabularies)).hexdigest()[:12]}"


def mixed_versions(runs: DataFrame, current: str) -> DataFrame:
    """Stored extractor versions other than the current one."""
    return runs.where(F.col("extractor_version") != current).groupBy("extractor_version").agg(F.count("*").alias("runs"))


def ingest_observations(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """W13-W15 for observations: one row per (edge, source_url) with the first and last time, from all batches so far."""
    key = ["source", "target", "relation_type", "source_url"]
    new = batch.groupBy(*key).agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    return new if stored is None else merged(stored, new, key, least=["first_seen"], greatest=["last_seen"])


def edges_of(support: DataFrame) -> DataFrame:
    return support.groupBy("source", "target", "relation_type").agg(F.count("*").alias("weight"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
