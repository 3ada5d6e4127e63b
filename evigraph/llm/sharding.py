"""Op 7, sharding: proportional stratified interleaving, DataFrame operations only.

Rows of a source are shuffled by a seeded hash and ranked; (rank - 1/2) / rows of the source spreads every source
evenly over [0, 1); rows are cut by their place in that order into shards whose counts differ by one at most, so every
shard holds the sources in the mixture of the whole.

Both ranks are taken inside narrow ranges of the order and added to the counts of the ranges before, so a source that
holds a third of all rows is ranked in many tasks.

Defined results: a null source is a stratum of its own, a null text has size 8 and the checksum of no bytes, and
repeated rows get a place each. With fewer rows than shards some shards stay empty. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept

#: Rows of a range in which ranks are taken, about.
RANGE_ROWS = 20_000


def _before(counts: DataFrame, part: list[str], by: str) -> DataFrame:
    """Adds `before`: the sum of n over smaller values of `by`, within `part`."""
    w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def shard(docs: DataFrame, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source): law `rows`."""
    total = docs.count()
    ranges = max(16, min(65_536, total // RANGE_ROWS))
    text, kept = F.coalesce(F.col(text_col), F.lit("")), Kept(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("stratum"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("h"),
    )
    share = F.conv(F.substring("h", 1, 4), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(share * ranges / 65_536))
    counts = rows.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    starts = _before(counts, ["stratum"], "range").withColumn("of", F.sum("n").over(Window.partitionBy("stratum"))).select("stratum", "range", "before", "of")
    ties = ["h", "doc_id", "text_crc32", "size"]
    ranked = (
        rows.withColumn("k", F.row_number().over(Window.partitionBy("stratum", "range").orderBy(*ties)))
        .join(starts, ["stratum", "range"])
        .withColumn("fraction", (F.col("before") + F.col("k") - F.lit(0.5)) / F.col("of"))
        .select("doc_id", "stratum", "source", "size", "text_crc32", "h", "fraction", F.floor(F.col("fraction") * ranges).alias("bin"))
    )
    ranked = kept.keep(ranked, "ranked")
    bins = _before(ranked.groupBy("bin").agg(F.count("*").alias("n")), [], "bin").select("bin", "before")
    place = F.col("before") + F.col("k") - 1
    return (
        ranked.withColumn("k", F.row_number().over(Window.partitionBy("bin").orderBy("fraction", "stratum", *ties)))
        .join(bins, "bin")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"cast(place * {shards}L div {max(total, 1)}L as int)"))
        .withColumn("slot", F.expr(f"place - (shard * {max(total, 1)}L + {shards - 1}L) div {shards}L"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
    )
