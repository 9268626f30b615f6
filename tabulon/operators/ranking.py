"""Ranks, orderings, top-k selections and step-up adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: str, value: Column, *ties: Column) -> DataFrame:
    """Unique ranks in each group: ties go to the given order, never shared."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(value, *ties)))


def ordering(df: DataFrame, by: str, name: str, value: str, tie: str) -> DataFrame:
    """Each group's names by ascending value as 'a < b < c', and the reverse. A group's rows are its few conditions."""
    rows = F.array_sort(F.collect_list(F.struct(value, tie, name)))
    joined = F.transform("rows", lambda r: r[name])
    return df.groupBy(by).agg(rows.alias("rows")).select(by, F.array_join(joined, " < ").alias("ascending"), F.array_join(F.reverse(joined), " > ").alias("descending"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: Spark keeps k in each partition and merges those."""
    return df.orderBy(*order).limit(k)


def top_in_groups(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits each partition's groups before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def step_up(df: DataFrame, p: str, m: int | Column, *ties: str, level: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg: p * m / rank, the least from the largest rank down, 1 at most. For families of hypotheses, which are few."""
    up = Window.partitionBy(*by).orderBy(F.col(p), *ties)
    down = Window.partitionBy(*by).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m if isinstance(m, Column) else F.lit(m)
    out = df.withColumn("rank", F.row_number().over(up)).withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col(p) * m / F.col("rank")).over(down)))
    return out.withColumn("reject", F.col("adjusted") <= level)
