"""Strengths kept up to date from a stream of edge changes.

A change is ``op`` ('add' or 'remove'), ``src``, ``dst`` and ``weight``.
Strengths are running sums of signed weights; with Structured Streaming each
micro-batch updates the nodes it touches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def signed_ends(changes: DataFrame, directed: bool = False, direction: str = "both") -> DataFrame:
    """``id, w`` for each end that a change adds to or takes from."""
    w = F.when(F.col("op") == "remove", -F.col("weight")).otherwise(F.col("weight"))
    both = F.array(F.struct(F.col("src").alias("id"), w.alias("w")), F.struct(F.col("dst").alias("id"), w.alias("w")))
    ends = both if not directed or direction == "both" else F.array(F.struct(F.col("src" if direction == "out" else "dst").alias("id"), w.alias("w")))
    return changes.select(F.explode(ends).alias("e")).select("e.id", "e.w")


def running_strength(changes: DataFrame, directed: bool = False, direction: str = "both") -> DataFrame:
    """``id, strength`` from a static or a streaming frame of changes."""
    return signed_ends(changes, directed, direction).groupBy("id").agg(F.sum("w").alias("strength"))


def start(changes: DataFrame, name: str, checkpoint: str, directed: bool = False, direction: str = "both") -> StreamingQuery:
    """Keep the strengths in the in-memory table ``name``; for production choose a sink with ``foreachBatch``."""
    return running_strength(changes, directed, direction).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def windowed_activity(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their summed value per tumbling window and type; data later than ``late`` is dropped by the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
