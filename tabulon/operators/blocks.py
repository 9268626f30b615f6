"""Orders and running values within groups, of which one may hold a third of all rows.

A group's rows are cut into blocks of consecutive order keys. A block is looked
at alone, and what blocks hand on (sizes, best values, last places) is one row
each, so no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Consecutive order keys in a block.
BLOCK = 1 << 16


def _handed_on(df: DataFrame, by: list[str], what: dict[str, Column]) -> DataFrame:
    """df with what, aggregated over the blocks before a row's own (null in the first). A null group is a group."""
    per = df.groupBy(*by, "_block").agg(*[c.alias(f"_own_{k}") for k, c in what.items()])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"before": F.sum, "best": F.max, "last": F.max}
    moved = per.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_block").alias("_k_block"), *[fold[k](f"_own_{k}").over(earlier).alias(f"_{k}") for k in what])
    same = F.col("_block") == F.col("_k_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(moved, same).drop("_k_block", *[f"_k_{c}" for c in by])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: its rows' places, from 0, in the order of columns that together repeat in no row (null first). A table.

    Rows are dealt by ranges of a sample; a range is put in order alone and
    moved by the sizes of those before it, of which there is one row each."""
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = written(dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1), "ranges")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def with_rank(df: DataFrame, by: list[str], key: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the place, from 0, of each row among its group's in the order of key, an integer that repeats in no group."""
    cut = df.withColumn("_block", F.floor(F.col(key) / block))
    own = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(key)) - 1
    moved = _handed_on(cut, by, {"before": F.count("*")})
    return moved.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_block", "_before")


def stopped_early(df: DataFrame, by: str, key: str, value: str, patience: int, block: int = BLOCK) -> DataFrame:
    """Of each group its best value, and stopped_at: the first key that stands patience rows after the last one that reached the best value so far.

    key is an integer that repeats in no group. A null value reaches nothing; before the first that does, rows count from the group's first."""
    cut = with_rank(df.select(by, key, value), [by], key, "_rank", block).withColumn("_block", F.floor(F.col(key) / block))
    running = Window.partitionBy(by, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = _handed_on(cut, [by], {"best": F.max(value)})
    reached = best.withColumn("_so_far", F.greatest("_best", F.max(value).over(running)))
    reached = reached.withColumn("_hit", F.when(F.col(value) >= F.col("_so_far"), F.col("_rank"))).drop("_best")
    last = _handed_on(reached, [by], {"last": F.max("_hit")}).withColumn("_since", F.coalesce(F.greatest("_last", F.max("_hit").over(running)), F.lit(0)))
    late = F.col("_rank") - F.col("_since") >= patience
    return last.groupBy(by).agg(F.max(value).alias("best"), F.min(F.when(late, F.col(key))).alias("stopped_at"))


def all_but_newest(df: DataFrame, by: str, order: list[str], keep: int) -> DataFrame:
    """Rows that go when each group keeps its newest ones by order, whose values repeat in no group; null is oldest.

    Only the kept rows are ranked (their number is limited before the shuffle); the rest is compared with the oldest of them."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    kept = df.select(by, *order).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= keep)
    bound = kept.where(F.col("_k") == keep).select(F.col(by).alias("_g"), F.struct(*order).alias("_bound"))
    return df.join(bound, F.col(by).eqNullSafe(F.col("_g"))).where(F.struct(*order) < F.col("_bound")).drop("_g", "_bound")


def quartiles(df: DataFrame, value: str, by: list[str], parts: int = 256) -> DataFrame:
    """by and q: the quartiles by linear interpolation, exact.

    Equal values are counted first. Approximate quantiles cut a group's values into parts, each of which is
    put in order alone; the sizes of those before it say which ranks it holds. Where the cuts fall depends on
    the order in which sketches are merged, so they are a table: parts and their sizes must have the same ones."""
    counted = written(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), "values")
    cuts = counted.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts"), F.sum("_n").alias("_total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    cuts = written(cuts.select(*[F.col(c).alias(f"_c_{c}") for c in by], "_cuts", "_total"), "cuts")
    # NaN is the greatest value, as in the engine's order
    placed = counted.join(cuts, same).withColumn("_block", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).select(*by, "_block", value, "_n", "_total")
    sized = _handed_on(placed, by, {"before": F.sum("_n")}).withColumn("_before", F.coalesce("_before", F.lit(0)))
    share = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    inside = sized.withColumn("_at", F.transform(share, lambda p: p * (F.col("_total") - 1)))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    ends = inside.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    at = lambda k, f: F.max(F.when((f(F.col("_at")[k]) >= F.col("_from")) & (f(F.col("_at")[k]) < F.col("_upto")), F.col(value)))
    found = ends.groupBy(*by).agg(F.first("_at").alias("_at"), *[f(k, g).alias(f"_{n}{k}") for k in range(3) for n, g, f in (("l", F.floor, at), ("h", F.ceil, at))])
    between = [F.when(F.col(f"_l{k}") == F.col(f"_h{k}"), F.col(f"_l{k}").cast("double")).otherwise(F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * (F.col("_at")[k] - F.floor(F.col("_at")[k]))) for k in range(3)]
    return found.select(*by, F.array(*between).alias("q"))
