"""Cluster bootstrap on sums by cluster, with draws made in parts from seeds that follow from the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Clusters are numbered within so many buckets, so no task numbers all of them.
BUCKETS = 256
#: Clusters that a task holds at a time, and clusters whose draws it makes together.
PART_SIZE, DRAW_BLOCK = 50_000, 256


def dense_index(df: DataFrame, key: str, name: str = "ix", buckets: int = BUCKETS) -> DataFrame:
    """Numbers 0.. for the distinct integer keys, by (key mod buckets, key): each bucket is numbered alone, then moved by the sizes of those before it."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("bucket", F.pmod(key, F.lit(buckets)))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("bucket", before.alias("before"))  # at most `buckets` rows
    return keys.join(F.broadcast(moved), "bucket").select(key, (F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1 + F.col("before")).alias(name))


def cluster_sums(df: DataFrame, cluster: str, sums: dict[str, Column]) -> DataFrame:
    """One row for each cluster: resampling works on sums, not on records."""
    return df.groupBy(cluster).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def _share(seed: list[int], totals: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """How many of each replicate's draws fall to part k of parts of these sizes. Halves are split by binomials
    seeded by their place in the tree, so that every task finds the same numbers and none waits for another."""
    ends, low, high = np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(totals, (ends[mid] - ends[low]) / (ends[high] - ends[low]))
        low, high, totals = (low, mid, left) if k < mid else (mid, high, totals - left)
    return totals


def _heads(known: DataFrame, by: list[str]) -> DataFrame:
    """by, _part and path: the nodes above each part in a binary tree of parts, with the clusters to the left and right of each. A part hears of as many
    nodes as the tree is deep, not of all parts."""
    sizes = known.groupBy(*by, "_part").agg(F.count("*").alias("n"), F.max("_parts").alias("_parts"))
    levels = F.when(F.col("_parts") > 1, F.sequence(F.lit(0), F.length(F.bin(F.col("_parts") - 1)) - 1)).otherwise(F.array().cast("array<int>"))
    climbed = sizes.select(*by, "_part", "n", F.explode(levels).alias("level")).withColumns({"node": F.expr("shiftright(_part, level + 1)"), "right": F.expr("shiftright(_part, level) & 1")})
    nodes = climbed.groupBy(*by, "level", "node").agg(F.sum(F.col("n") * (1 - F.col("right"))).alias("n_left"), F.sum(F.col("n") * F.col("right")).alias("n_right"))
    above = climbed.select(*by, "_part", "level", "node").join(nodes, [*by, "level", "node"]).groupBy(*by, "_part").agg(F.collect_list(F.struct("level", "node", "n_left", "n_right")).alias("path"))
    return sizes.select(*by, "_part").join(above, [*by, "_part"], "left").select(*[F.col(c).alias(f"_h_{c}") for c in [*by, "_part"]], "path")


def _own_draws(seed: int, part: int, path: list[dict] | None, own: int, r: int) -> np.ndarray:
    """How many of each replicate's draws fall to a part: halves of the tree are split by binomials seeded by their node,
    so that every task finds the same numbers and none waits for another."""
    nodes = sorted([] if path is None else path, key=lambda x: -x["level"])
    totals = np.full(r, nodes[0]["n_left"] + nodes[0]["n_right"] if nodes else own)
    for x in nodes:
        left = np.random.default_rng([seed, 0, x["level"], x["node"]]).binomial(totals, x["n_left"] / (x["n_left"] + x["n_right"]))
        totals = totals - left if part >> x["level"] & 1 else left
    return totals


def _in_parts(sums: DataFrame, by: list[str], cluster: str, columns: list[str], r: int, seed: int, part_size: int, result, schema: str) -> DataFrame:
    """result(own, blocks) for each part: own has its clusters in order, blocks are (start, counts by replicate and cluster)."""
    known = sums.where(" and ".join(f"`{c}` is not null" for c in [*by, cluster])).select(*by, cluster, *columns)
    parts = known.groupBy(*by).agg(F.ceil(F.count("*") / part_size).alias("_parts"))
    keyed = known.join(parts, by).withColumn("_part", F.pmod(F.xxhash64(cluster), F.col("_parts")))

    def drawn(own: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(cluster)
        part = int(head["_h__part"].iloc[0])
        mine = _own_draws(seed, part, head["path"].iloc[0], len(own), r)
        starts = np.arange(0, len(own), DRAW_BLOCK)
        lengths = np.minimum(DRAW_BLOCK, len(own) - starts)

        def blocks():
            for b, (start, m) in enumerate(zip(starts, lengths, strict=True)):
                rep = np.repeat(np.arange(r), _share([seed, 1, part], mine, lengths, b))
                picks = np.random.default_rng([seed, 2, part, b]).integers(0, m, rep.size)
                yield start, np.bincount(rep * m + picks, minlength=r * m).reshape(r, m)

        return result(own, blocks())

    heads = _heads(keyed, by)
    return keyed.groupBy(*by, "_part").cogroup(heads.groupBy(*[f"_h_{c}" for c in by], "_h__part")).applyInPandas(drawn, schema)


def _fields(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema]


def multinomial_replicates(sums: DataFrame, by: list[str], cluster: str, columns: list[str], r: int, seed: int = 42, part_size: int = PART_SIZE) -> DataFrame:
    """by, rep and the columns' totals (doubles; whole numbers are exact below 2^53) over each replicate's draws of clusters, as many as a group has.

    sums has one row for each group and cluster; without by, all are one group. Draws are made where the clusters
    are: a group is dealt to parts of about part_size clusters by a hash, a tree of binomials says how many draws
    each part has in each replicate, and a part multiplies its counts with its sums. What is shuffled after that is
    r rows a part, not r rows a cluster. Parts and seeds follow from the data, so a task that runs again draws the
    same, and any columns of the same clusters share draws. A null total counts as 0; rows with a null group or
    cluster are left out."""
    if not by:
        return multinomial_replicates(sums.withColumn("_all", F.lit(0)), ["_all"], cluster, columns, r, seed, part_size).drop("_all")

    def totals(own: pd.DataFrame, blocks) -> pd.DataFrame:
        x = own[columns].astype(float).fillna(0.0).to_numpy()
        out = np.zeros((r, len(columns)))
        for start, counts in blocks:
            out += counts @ x[start : start + counts.shape[1]]
        keys = {c: [own[c].iloc[0]] * r for c in by}
        return pd.DataFrame(keys | {"rep": np.arange(r)} | {c: out[:, k] for k, c in enumerate(columns)})

    schema = ", ".join([*_fields(sums, by), "rep int", *(f"`{c}` double" for c in columns)])
    each = _in_parts(sums, by, cluster, columns, r, seed, part_size, totals, schema)
    return each.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in columns])


def multinomial_draws(sums: DataFrame, by: list[str], cluster: str, r: int, seed: int = 42, part_size: int = PART_SIZE) -> DataFrame:
    """by, cluster, rep and times (above 0): the draws that multinomial_replicates takes of the same clusters, for audits of few replicates."""
    if not by:
        return multinomial_draws(sums.withColumn("_all", F.lit(0)), ["_all"], cluster, r, seed, part_size).drop("_all")

    def rows(own: pd.DataFrame, blocks) -> pd.DataFrame:
        out = []
        for start, counts in blocks:
            rep, at = np.nonzero(counts)
            out.append(own[[*by, cluster]].iloc[start + at].assign(rep=rep, times=counts[rep, at]))
        return pd.concat(out)

    return _in_parts(sums, by, cluster, [], r, seed, part_size, rows, ", ".join([*_fields(sums, [*by, cluster]), "rep int", "times long"]))


def interval(values: DataFrame, stats: dict[str, Column], level: float = 0.95) -> DataFrame:
    """statistic, low, high: percentile limits by linear interpolation, over replicates where the statistic is defined."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), c.cast("double").alias("v")) for k, c in stats.items()]))
    long = values.select(each.alias("e")).select("e.*").where("v is not null and not isnan(v)")
    q = F.expr(f"percentile(v, array({(1 - level) / 2}, {(1 + level) / 2}))")
    return long.groupBy("statistic").agg(q.alias("q"), F.count("*").alias("replicates")).select("statistic", F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"), "replicates")


def two_sided(values: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """statistic, p: twice the smaller tail over V + 1 replicates, ties at 0 on both sides, 1 at most."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), c.cast("double").alias("v")) for k, c in stats.items()]))
    long = values.select(each.alias("e")).select("e.*").where("v is not null and not isnan(v)")
    tail = F.least(F.count_if(F.col("v") <= 0), F.count_if(F.col("v") >= 0))
    return long.groupBy("statistic").agg(F.round(F.least(F.lit(1.0), 2.0 * (1 + tail) / (F.count("*") + 1)), 9).alias("p"))
