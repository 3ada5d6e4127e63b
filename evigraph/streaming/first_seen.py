"""Incremental support of edges from a stream: each micro-batch is merged into the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Snapshots, ingest_observations


def into_snapshots(stream: DataFrame, store: Snapshots, checkpoint: str, version: str = "1"):
    """A started query that publishes a snapshot of `support` for every micro-batch. Merging takes minima and maxima, so a
    batch that is delivered twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        stored = store.read("support") if store.version else None
        store.publish(version, support=ingest_observations(stored, batch))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_support(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Observations per edge and time window, with late data up to the watermark."""
    return stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", width), "source", "target", "relation_type").agg(F.count("*").alias("n"))
