"""Streams of triples: the combiner of a table as a running aggregate, and windowed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.semiring import fold


def running_combine(stream: DataFrame, plus: str = "plus") -> DataFrame:
    """Each key with the fold of all its entries so far (update or complete mode)."""
    return stream.groupBy("row", "col").agg(fold(plus, stream.schema["val"].dataType)(F.col("val")).alias("val"))


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling or sliding windows over ts; entries later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "row", "col").agg(F.count("*").alias("n"), F.sum("val").alias("val"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "row").agg(F.count("*").alias("n"), F.sum("val").alias("val"))


def first_copies(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["row", "col"])


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, as Parquet, resumable from the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")
