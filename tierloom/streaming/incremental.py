"""Streams of files and events: new files are measured once, late events are counted in their windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, glob: str = "*.wav") -> StreamingQuery:
    """Run `work` on (path, content) of the files that no earlier call has seen, and append its rows as Parquet."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return work(files.select("path", "content")).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and mean values in tumbling or sliding windows; rows later than `late` behind the stream are dropped by its watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
