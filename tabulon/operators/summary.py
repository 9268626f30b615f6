"""Numeric summaries, histograms and weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import quartiles


def numeric(df: DataFrame, value: str, by: list[str], cluster: str) -> DataFrame:
    """n, clusters, mean, median, sample SD (0 of one row), quartiles by linear interpolation."""
    kept = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(cluster).alias("clusters"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    q = quartiles(df, value, by).select(*[F.col(c).alias(f"_q_{c}") for c in by], "q")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    a = kept.join(q, same)
    r = lambda c: F.round(c, 6)
    return a.select(*by, "n", "clusters", r(F.col("m")).alias("mean"), r(F.col("q")[1]).alias("median"), r(F.coalesce("sd", F.lit(0.0))).alias("sd"), r(F.col("q")[0]).alias("q25"), r(F.col("q")[2]).alias("q75"))


def spread(df: DataFrame, value: str, by: list[str], bound: float) -> DataFrame:
    """Mean, population SD, range, and rows below and from bound on. NaN and null don't count."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = F.count("*")
    low = F.count_if(F.col(value) < bound)
    return kept.groupBy(*by).agg(n.alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), low.alias("n_low"), (n - low).alias("n_high"), F.round(100.0 * low / n, 6).alias("percent_low"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins over [low, high], the last one closed; bins without rows count 0, values outside go in none."""
    inside = df.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    have = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(have, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_mean(df: DataFrame, value: Column, weight: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.try_divide(F.sum(value * weight), F.sum(weight)), 6).alias("weighted_mean"), F.count("*").alias("n"))


def stages(log: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Seconds and segments of each stage over all restarts of a log that is appended to."""
    return log.groupBy(stage).agg(F.round(F.sum(seconds), 6).alias("seconds"), F.count("*").alias("segments"))
