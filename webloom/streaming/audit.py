"""Audit streams: micro-batch sinks, event-time windows, TTL dedup and the state folds online."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts by kind; an extension beside the reference's wall-clock state."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def dedup_ttl(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """The first event of a key within the time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def _aimd(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    factor = state.get[0] if state.exists else 1.0
    n = 0
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ok in rows["ok"]:
        factor = max(1.0, factor * 0.9) if ok else min(32.0, factor * 2.0)
        n += 1
    state.update((factor,))
    yield pd.DataFrame({"user_id": [key[0]], "factor": [factor], "n": [n]})


def aimd(events: DataFrame) -> DataFrame:
    """Rate factor per user after each micro-batch; the same transitions as operators.state.aimd."""
    rows = events.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return rows.groupBy("user_id").applyInPandasWithState(_aimd, "user_id long, factor double, n long", "factor double", "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events that are at most `gap` apart; an extension beside the reference."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def append_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Any:
    """Batches of rows as Parquet, each batch once: a repeated batch id overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_batches(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """What append_sink's folder says: the last batch (complete results), or the last row of each key (updates)."""
    rows = spark.read.parquet(path)
    if keys is None:
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_last")).select(*keys, "_last.*")
