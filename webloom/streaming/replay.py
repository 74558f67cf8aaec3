"""Stored events as a stream of bounded batches in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows for which a slice gets one more file.
FILE_ROWS = 200_000


def time_slices(events: DataFrame, path: str, slices: int) -> int:
    """events as files for each of so many stretches of time (`ts`) with about equally many rows, written in their order.

    A stream takes files by their age, so a slice a trigger replays them in order and bounds a batch by a slice. Returns the
    number of files that each slice has: one for each FILE_ROWS rows of the smallest slice, so that large slices are written by
    many tasks, and none of a slice's files can be without rows and missing.
    """
    seconds = F.unix_micros("ts").cast("double")
    edges = sorted(set(events.select(seconds.alias("at")).approxQuantile("at", [k / slices for k in range(1, slices)], 0.001))) if slices > 1 else []
    spans = [(F.lit(True) if low is None else seconds >= low) & (F.lit(True) if high is None else seconds < high) for low, high in zip([None, *edges], [*edges, None], strict=True)]
    files = max(1, min(events.agg(*map(F.count_if, spans)).first()) // FILE_ROWS)
    for k, within in enumerate(spans):
        events.filter(within).repartition(files).write.mode("append").parquet(f"{path}/{k}")
    return files


def replayed(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the slices at `path`, each of so many files, one slice a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
