"""Lookups: pending work, defaults, composite keys, the batch before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of one key that a task may meet in a join.
KEY_ROWS = 1 << 17


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a result yet; null keys are pending. What both sides repeat is taken once before they meet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def resumed(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return tasks.join(done.select(key).distinct(), key, "left_semi")


def last_written(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One value for each key, the one with the largest order, and how many it overwrote."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), (F.count("*") - 1).alias("overwritten"))


def array_key(values: Column) -> Column:
    """One string for an array of strings: equal for equal arrays alone, whatever their values hold. Null elements are kept apart from empty ones."""
    return F.to_json(F.struct(values.alias("v")), {"ignoreNullFields": "false"})


def patched(records: DataFrame, source: DataFrame, keys: list[str], value: str, replacement: str, former: str, order: str) -> DataFrame:
    """records with value replaced by what source has under the same keys, of which any may be arrays of strings.

    Adds status (miss, unchanged or changed, by trimmed texts), overwritten (how
    many rows of source the one taken has overwritten: the last by order wins)
    and agreed (if the value was the one that source calls former). One
    aggregate finds the last row and the collisions, one join patches. Null keys
    match nothing; a null element of an array matches a null element."""
    kinds = dict(records.dtypes)
    key = lambda c: array_key(F.col(c)) if kinds[c].startswith("array") else F.col(c)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = lambda df: df.select("*", *[F.when(F.col(c).isNotNull(), key(c)).alias(n) for c, n in zip(keys, names, strict=True)])
    last = keyed(source).groupBy(*names).agg(F.max_by(F.struct(F.col(replacement).alias("new"), F.col(former).alias("old")), order).alias("_hit"), (F.count("*") - 1).alias("overwritten"))
    met = keyed(records).join(last, names, "left").drop(*names)
    same = lambda c: F.coalesce(F.trim(value) == F.trim(c), F.lit(False))
    new = F.col("_hit.new")
    status = F.when(F.col("_hit").isNull(), "miss").when(same(new), "unchanged").otherwise("changed")
    return met.withColumns({"status": status, "agreed": F.when(F.col("_hit").isNotNull(), same(F.col("_hit.old"))), value: F.when(F.col("_hit").isNotNull() & ~same(new), new).otherwise(F.col(value))}).drop("_hit")


def with_default(left: DataFrame, lookup: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """left with the lookup's value, else the default; lookup has one row for each key."""
    return left.join(lookup.select(*keys, F.col(value).alias("_found")), keys, "left").withColumn(value, F.coalesce("_found", default)).withColumn("hit", F.col("_found").isNotNull()).drop("_found")


def previous_other(df: DataFrame, index: str, key: str, batch: int) -> DataFrame:
    """For each row the first row of the batch before with another key; null where there is none.

    Of the batch before, the first row and the first one with another key than
    that are all that is needed: two rows a batch, whatever its size."""
    b = df.withColumn("batch", F.floor(F.col(index) / batch))
    first = b.groupBy("batch").agg(F.min_by(key, index).alias("first_key"))
    second = b.join(first, "batch").where(F.col(key) != F.col("first_key")).groupBy("batch").agg(F.min_by(key, index).alias("second_key"))
    both = first.join(second, "batch", "left").withColumn("batch", F.col("batch") + 1)
    other = F.when(F.col("first_key") != F.col(key), F.col("first_key")).otherwise(F.col("second_key"))
    return b.join(both, "batch", "left").select(index, key, other.alias("other"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key at most; how: inner or left.

    A key with more than most (KEY_ROWS) rows of left is met where its rows are: right's
    rows of such keys, of which there are fewer than left has rows over most,
    are broadcast. left is read twice, so it should be a table. Null keys match
    nothing and aren't moved."""
    known = left.where(" and ".join(f"`{k}` is not null" for k in keys))
    hot = known.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (KEY_ROWS if most is None else most)).select(*keys)
    if hot.isEmpty():
        out = known.join(right, keys, how)
    else:
        hot = F.broadcast(written(hot, "hot-keys"))
        out = known.join(hot, keys, "left_anti").join(right, keys, how)
        out = out.unionByName(known.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how))
    if how == "left":
        rest = left.where(" or ".join(f"`{k}` is null" for k in keys))
        out = out.unionByName(rest, allowMissingColumns=True)
    return out
