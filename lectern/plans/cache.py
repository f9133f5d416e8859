"""A content cache: fetched bytes as a table, partitioned by the first byte of their keys.

A run asks for what it wants by key. What the cache doesn't have is fetched once a key, written, and
counted; all of it is then read from the table, so nothing is fetched twice, neither by a later run nor
by a task that is repeated. Keys of the SHA-256 of their parts; a null content is fetched anew each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import cache_key, cache_shard
from ..schemas import record
from ..session import file_system

SCHEMA = record(key="string", content=T.BinaryType(), shard="string")


class ContentCache:
    """`bytes_downloaded` counts what was fetched through this object, not what the cache had."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.bytes_downloaded = spark, path.rstrip("/"), 0

    def table(self) -> DataFrame:
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def get_or_fetch(self, wanted: DataFrame, parts: list, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of `wanted` with their content. `fetch` gets those that are missing, with column `_key`, and returns (_key, content)."""
        keyed = wanted.withColumn("_key", cache_key(*parts))
        asked = keyed.dropDuplicates(["_key"]).withColumn("_shard", cache_shard("_key"))
        have = self.table().select(F.col("shard").alias("_shard"), F.col("key").alias("_key"))
        missing = asked.join(have, ["_shard", "_key"], "left_anti").drop("_shard")
        if missing.isEmpty():
            return self._with_content(keyed)
        found = fetch(missing).where("content is not null").select(F.col("_key").alias("key"), "content", cache_shard("_key").alias("shard"))
        # few files: a partition of the cache is written by one task
        seen = Observation()
        counted = found.repartition("shard").observe(seen, F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n"))
        counted.write.mode("append").partitionBy("shard").parquet(self.path)
        self.bytes_downloaded += seen.get.get("n") or 0
        return self._with_content(keyed)

    def _with_content(self, keyed: DataFrame) -> DataFrame:
        held = self.table().select(F.col("key").alias("_key"), "content").dropDuplicates(["_key"])
        return keyed.join(held, "_key", "left").drop("_key")
