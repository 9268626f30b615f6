"""A store that a manifest locks: what may be appended, and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrity import key_audit

FIELDS = ("primary_key", "row_hash", "status")


class StoreViolation(ValueError):
    """A batch breaks the store's rules; nothing of it was written."""


def verdicts(batch: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Each row of the batch with its verdict: accepted, or the first rule that it breaks. manifest and stored: primary_key, row_hash."""
    known = manifest.select("primary_key", F.col("row_hash").alias("_expected")).distinct()
    there = stored.select("primary_key").distinct().withColumn("_stored", F.lit(True))
    times = batch.groupBy("primary_key").agg(F.count("*").alias("_times"))
    joined = batch.join(known, "primary_key", "left").join(there, "primary_key", "left").join(times, "primary_key", "left")
    verdict = F.when(F.col("_expected").isNull(), "foreign_key").when(F.col("row_hash") != F.col("_expected"), "hash_mismatch").when(F.col("status") != "success", "not_successful").when(F.col("_stored").isNotNull() | (F.col("_times") > 1), "duplicate_key").otherwise("accepted")
    return joined.withColumn("verdict", verdict).drop("_expected", "_stored", "_times")


def append(batch: DataFrame, manifest: DataFrame, path: str, errors: str | None = None) -> int:
    """Appends a batch to the Parquet store at path and returns its rows. Rows that weren't successful go to errors if that is given; any other verdict raises, and nothing is written."""
    spark = batch.sparkSession
    judged = verdicts(batch, manifest, read(spark, path, batch)).persist()
    try:
        counts = {r.verdict: r["count"] for r in judged.groupBy("verdict").count().collect()}
        bad = {k: n for k, n in counts.items() if k not in ("accepted", "not_successful" if errors else "")}
        if bad:
            raise StoreViolation(", ".join(f"{k}: {n}" for k, n in sorted(bad.items())))
        if errors and counts.get("not_successful"):
            judged.where("verdict = 'not_successful'").drop("verdict").write.mode("append").parquet(errors)
        if counts.get("accepted"):
            judged.where("verdict = 'accepted'").drop("verdict").write.mode("append").parquet(path)
        return counts.get("accepted", 0)
    finally:
        judged.unpersist()


def read(spark, path: str, like: DataFrame) -> DataFrame:
    """The store's rows; none before the first append."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def audit(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    return key_audit(manifest, stored, "primary_key")
