"""Resumable ingestion as streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.store import append, read


def ingest(spark: SparkSession, source: str, schema: StructType, manifest: DataFrame, path: str, checkpoint: str, errors: str | None = None) -> StreamingQuery:
    """Reads new files of source and appends them under the store's rules; ends when it has seen all.

    A batch that failed between its append and its commit is tried again: rows
    that the store already has under the same hash are left out then, so a
    restart neither raises nor doubles them."""

    def each(batch: DataFrame, _: int) -> None:
        there = read(spark, path, batch).select("primary_key", "row_hash").distinct()
        append(batch.join(there, ["primary_key", "row_hash"], "left_anti").select(*schema.names), manifest, path, errors)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str, width: str, by: list[str]) -> DataFrame:
    """Rows in each time window; rows later than `late` behind the newest are left out by the watermark of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def cached(tasks: DataFrame, cache: str, score: Callable[[DataFrame], DataFrame], key: str = "prompt_hash") -> DataFrame:
    """tasks with their scores: only keys that the Parquet table cache lacks are scored, each once, and appended."""
    spark = tasks.sparkSession
    empty = score(tasks.limit(0))
    known = read(spark, cache, empty)
    new = tasks.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    score(new).write.mode("append").parquet(cache)
    return tasks.join(read(spark, cache, empty), key, "left")
