"""Constraints over tables: hashes of columns, key sets, alignment, shards. Findings are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha_of_rows


def ordered_hash(df: DataFrame, by: list[str], value: str, order: str, block: int = 4096) -> DataFrame:
    """SHA-256 of a column in order, for each group: of the digests of its blocks of `block` consecutive order values.

    Hashing block by block keeps any one row bounded: a group of any size
    becomes its blocks' digests."""
    blocks = df.groupBy(*by, F.floor(F.col(order) / block).alias("block")).agg(sha_of_rows(F.col(order), F.col(value).cast("string")).alias("digest"), F.count("*").alias("n"))
    return blocks.groupBy(*by).agg(sha_of_rows(F.col("block"), F.col("digest")).alias("digest"), F.sum("n").alias("n"))


def key_audit(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: distinct expected and actual keys, missing, unexpected, repeated, and if the sets are equal."""
    e = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("a"))
    both = e.unionByName(actual.select(key, F.lit(0).alias("e"), F.lit(1).alias("a"))).groupBy(key).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    missing, extra = F.count_if(F.expr("e > 0 and a = 0")), F.count_if(F.expr("e = 0 and a > 0"))
    return both.agg(F.count_if(F.expr("e > 0")).alias("expected"), F.count_if(F.expr("a > 0")).alias("actual"), missing.alias("missing"), extra.alias("unexpected"), F.count_if(F.expr("a > 1")).alias("repeated"), ((missing == 0) & (extra == 0)).alias("exact"))


def alignment(p: DataFrame, n_conditions: int) -> DataFrame:
    """By arm: records, those with all conditions, and those whose gold label or frame varies between conditions."""
    # a bit for each condition makes one partial aggregate; counting distinct names takes two shuffles
    seen = F.bit_count(F.bit_or(F.expr("shiftleft(1, condition_ix)"))) if "condition_ix" in p.columns else F.countDistinct("condition")
    r = p.groupBy("arm", "record_id").agg(seen.alias("conditions"), F.min("gold").alias("g0"), F.max("gold").alias("g1"), F.min("frame_id").alias("f0"), F.max("frame_id").alias("f1"))
    return r.groupBy("arm").agg(F.count("*").alias("in_any"), F.count_if(F.col("conditions") == n_conditions).alias("in_all"), F.count_if(F.expr("g0 <> g1")).alias("gold_varies"), F.count_if(F.expr("f0 <> f1")).alias("frame_varies"), F.bool_and((F.col("conditions") == n_conditions) & (F.col("g0") == F.col("g1")) & (F.col("f0") == F.col("f1"))).alias("aligned"))


def shard_audit(sharded: DataFrame, parent: DataFrame, key: str, shard: str = "shard") -> DataFrame:
    """By shard: rows, distinct keys, keys that other shards hold too, and keys that the parent hasn't."""
    own = sharded.groupBy(key).agg(F.countDistinct(shard).alias("shards"))
    told = sharded.join(own, key).join(parent.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    return told.groupBy(shard).agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count_if(F.expr("shards > 1")).alias("shared"), F.count_if(F.expr("known is null")).alias("foreign"))


def drop_reasons(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the first check that fails, in the given order; 'kept' if none does."""
    reason = F.lit("kept")
    for name, bad in reversed(checks):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def check(name: str, holds: Column, evidence: Column, df: DataFrame) -> DataFrame:
    """(check, status, evidence) of an aggregate over df: union these, and fail at the end on any FAIL."""
    return df.agg(holds.alias("h"), evidence.cast("string").alias("evidence")).select(F.lit(name).alias("check"), F.when(F.col("h"), "PASS").otherwise("FAIL").alias("status"), "evidence")


def first_by_content(df: DataFrame, content: Column, name: str) -> DataFrame:
    """Distinct contents by hash: the smallest name, and how many copies beside it. Partial aggregates take up any number of copies."""
    return df.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min(name).alias("first_id"), (F.count("*") - 1).alias("copies"))
