"""Incremental ingest of incidences with Structured Streaming.

Percentiles and boundary points change with any new frame, so clusters are computed anew from the
accumulated table; what the stream keeps up to date is the table itself, without repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.incidence import KEYS


def ingest(stream: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, list], None] | None = None) -> StreamingQuery:
    """Appends new incidences of a stream to Parquet by scene; ``after(table, scenes)`` runs when scenes have changed.

    A batch that is delivered again adds nothing: its rows are in the table already.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.select(KEYS).dropna().distinct().persist()
        try:
            scenes = [r["seq"] for r in fresh.select("seq").distinct().collect()]  # the few scenes of one batch
            if not scenes:
                return
            try:
                old = spark.read.parquet(path).where(F.col("seq").isin(scenes)).select(KEYS)
                new = fresh.join(old, KEYS, "left_anti")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                new = fresh
            new.write.mode("append").partitionBy("seq").parquet(path)
            if after:
                after(spark.read.parquet(path).where(F.col("seq").isin(scenes)), scenes)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed_points(stream: DataFrame, event_time: str, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Points seen by each mask per window of event time: a running view of the ingest, late rows up to ``delay``."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window), "seq", "frame_id", "mask_id")
        .agg(F.approx_count_distinct("point_id").alias("points"))
        .select(F.col("window.start").alias("start"), "seq", "frame_id", "mask_id", "points")
    )
