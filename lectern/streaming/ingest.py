"""Streaming ingestion: newly arrived archives or rows become micro-batches of the same resumable plan.

Each micro-batch writes its chunks, then its manifest rows; a batch that is replayed after a failure
finds its targets in the manifest, or its chunks in the corpus, and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Settings
from ..plans.ingest import ingest
from ..schemas import record


def archive_stream(spark: SparkSession, root: str, max_files: int = 100) -> DataFrame:
    """(key, content) of archives as they arrive below a folder."""
    schema = record(path="string", modificationTime=T.TimestampType(), length="bigint", content=T.BinaryType())
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.meca").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return files.select(F.regexp_extract("path", r"((?:Current|Back)_Content/.*)$", 1).alias("key"), "content")


def ingest_stream(rows: DataFrame, load, corpus: str, checkpoint: str, mode: str = "analysis", settings: Settings | None = None, once: bool = True) -> StreamingQuery:
    """Ingest a stream of targets (target_id and what `load` needs) into a corpus.

    `once` processes what there is and ends; else the query goes on until it is stopped."""

    def batch(df: DataFrame, _: int) -> None:
        ingest(df.sparkSession, df, load, corpus, mode, settings)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_chunks(chunks: DataFrame, time_column: str, delay: str = "1 hour") -> DataFrame:
    """A stream of chunks, each id once within the watermark's delay; the state stays bounded."""
    return chunks.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["chunk_id"])


def arrivals(events: DataFrame, time_column: str, key: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window of event time; late rows within the delay count. Ours, not of the batch plan."""
    found = events.withWatermark(time_column, delay).groupBy(F.window(time_column, window), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("window_start"), key, "n")
