"""Streams: not part of what the engine is compared on, but the same operators where they can run without end.

`tumbling` is the same plan for a batch and a stream; in a stream, late rows beyond the watermark are dropped and each window is written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(df: DataFrame, width: str, stamp: str, keys: Sequence[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """keys, start, n, mean, std of value in each window."""
    rows = df.withWatermark(stamp, late) if late and df.isStreaming else df
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    out = rows.groupBy(w.alias("_w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(*keys, F.col("_w.start").alias("start"), "n", "mean", "std")


def sessions(df: DataFrame, gap: str, stamp: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """keys, start, end, n of runs of rows with no pause of `gap`."""
    rows = df.withWatermark(stamp, late) if late and df.isStreaming else df
    out = rows.groupBy(F.session_window(stamp, gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a stream to Parquet, exactly once, from where its checkpoint left off."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
