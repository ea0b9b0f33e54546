"""A folder as a stream of files (an addition: the batch job run again and again over a folder does the same).

Each new file is decoded once; its audio rows, errors included, are appended to a table. With a checkpoint
location a stream that is started again goes on where it ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import ship_package
from ..sources.decode import decode_files
from ..sources.discovery import EXTENSIONS

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def audio_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 64, recursive: bool = True) -> DataFrame:
    """``file_id, path, content, mtime`` of files as they come; the id is a hash of the path."""
    glob = "*.{" + ",".join(map(_any_case, EXTENSIONS)) + "}"
    rows = (
        spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "content", F.col("modificationTime").alias("mtime"))


def decode_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, *, once: bool = True, **how) -> StreamingQuery:
    """Append decoded audio to Parquet at ``out``; ``once``: what is there now, then end."""
    ship_package(spark)
    rows = decode_files(audio_stream(spark, folder, **how))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def activity_windows(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by hour and kind over a stream of events, with late ones up to ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
