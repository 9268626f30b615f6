"""Balanced subsets, derangements, shards and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, written
from .blocks import numbered, with_rank
from .bootstrap import dense_index


def quotas(sizes: dict[str | None, int], first: dict[str | None, int], target: int) -> dict[str | None, int]:
    """Equal shares, no more than a class has; what is left goes round the classes in order of first appearance."""
    names = sorted(sizes, key=lambda c: (first[c], str(c)))
    base = target // max(1, len(names))
    out = {c: min(base, sizes[c]) for c in names}
    left = min(target, sum(sizes.values())) - sum(out.values())
    while left > 0:
        for c in names:
            if left and out[c] < sizes[c]:
                out[c] += 1
                left -= 1
    return out


def balanced(df: DataFrame, label: str, index: str, percent: float, seed: int = 42) -> DataFrame:
    """percent of the rows, balanced over the label's classes (null is one): in each class those with the smallest seeded hash of index.

    Only class sizes reach the driver. The window's limit is applied in each
    partition first, so a class of most rows isn't sorted in one task."""
    stats = df.groupBy(label).agg(F.count("*").alias("n"), F.min(index).alias("first")).collect()
    total = sum(r.n for r in stats)
    want = quotas({r[label]: r.n for r in stats}, {r[label]: r.first for r in stats}, max(1, int(total * percent / 100)))
    quota = F.lit(0)
    for c, q in want.items():
        quota = F.when(F.col(label).eqNullSafe(F.lit(c)), q).otherwise(quota)
    most = max(want.values(), default=0)
    order = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(index).cast("string"))), F.col(index)))
    return df.withColumn("pick", order).where(F.col("pick") <= most).where(F.col("pick") <= quota)


def derangement(df: DataFrame, key: str, frame: str) -> DataFrame:
    """Pairs (source, target): a one-to-one map without fixed points in which target's frame differs from source's.

    Rows are numbered by (frame, key) and each takes the one that is the size of
    the largest frame further on, in a circle: valid while that is at most half
    of all rows. A larger frame would have to meet itself, so the job fails.
    Frames are numbered by buckets, and their rows by blocks of key, an integer."""
    frames = df.groupBy(frame).agg(F.count("*").alias("size"))
    ix = dense_index(frames, frame, "frame_ix")
    buckets = frames.join(ix, frame).withColumn("block", F.floor(F.col("frame_ix") / 1024))
    totals = buckets.groupBy("block").agg(F.sum("size").alias("n"))
    before = totals.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("frame_ix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    offsets = buckets.join(before, "block").select(frame, start.alias("start"))
    largest, total = F.max("size"), F.sum("size")
    facts = frames.agg(F.when(2 * largest > total, F.raise_error(F.concat(F.lit("no derangement: a frame has "), largest.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows")))).otherwise(largest).alias("shift"), total.alias("total"))
    ranked = with_rank(df.select(key, frame), [frame], key, "rank")
    placed = ranked.join(offsets, frame).withColumn("place", F.col("start") + F.col("rank")).drop("rank")
    moved = placed.crossJoin(F.broadcast(facts))  # one row
    source = moved.select(F.col(key).alias("source"), F.col(frame).alias("source_frame"), ((F.col("place") + F.col("shift")) % F.col("total")).alias("place"))
    target = placed.select(F.col(key).alias("target"), F.col(frame).alias("target_frame"), "place")
    return source.join(target, "place").select("source", "target", "source_frame", "target_frame")


#: A frame with a larger share of all rows is mended by ranks, in a round of its own; there are fewer than one over the share.
LARGE_FRAME = 0.125


class Infeasible(ValueError):
    """Some frame has more than half of all rows, so two of its rows would have to meet."""


def random_derangement(df: DataFrame, key: str, frame: str, seed: int) -> DataFrame:
    """Pairs (source, target, source_frame, target_frame): a random one-to-one map in which target's frame differs from source's. A table.

    df: one row a key; null is a frame like any other. Two seeded orders are
    dealt by ranges and put side by side. Pairs that clash swap targets with
    others: a large frame's clashes with as many pairs that don't touch the
    frame, by rank (there are enough as long as it has at most half of all rows,
    else Infeasible is raised); the rest with pairs drawn at random, round by
    round, where a pair takes part in one swap. A swap never makes a clash, so
    rounds end, after about the logarithm of the clashes."""
    rows = df.select(F.col(key).alias("k"), F.col(frame).cast("string").alias("f"))
    sizes = rows.groupBy("f").agg(F.count("*").alias("n"))
    facts = sizes.agg(F.sum("n").alias("total"), F.max(F.struct("n", "f")).alias("most")).first()
    if facts.total and 2 * facts.most.n > facts.total:
        raise Infeasible(f"frame {facts.most.f} has {facts.most.n} of {facts.total} rows")
    n = facts.total or 0
    side = lambda name: numbered(rows.withColumn("h", F.xxhash64(F.lit(f"{seed}|{name}"), F.col("k").cast("string"))), ["h", "k"], "place").drop("h")
    pairs = side("sources").join(side("targets").select("place", F.col("k").alias("t"), F.col("f").alias("g")), "place")
    pairs = written(pairs, "pairs")
    clash = F.col("f").eqNullSafe(F.col("g"))
    # fewer than one over LARGE_FRAME rows
    for large in [r.f for r in sizes.where(F.col("n") > LARGE_FRAME * n).orderBy("f").collect()]:
        of = lambda c, f=large: F.col(c).eqNullSafe(F.lit(f))
        stuck = numbered(pairs.where(of("f") & of("g")).select("place"), ["place"], "rank")
        away = pairs.where(~of("f") & ~of("g")).select("place", F.xxhash64(F.lit(seed), F.lit(large), "place").alias("h"))
        away = numbered(away, ["h", "place"], "rank").select("rank", F.col("place").alias("other"))
        pairs = _swapped(pairs, stuck.join(away, "rank").select("place", "other"))
    turn = 0
    while not (stuck := pairs.where(clash)).isEmpty():
        turn += 1
        drawn = stuck.select("place", "f", F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "place"), F.lit(n)).alias("other"))
        met = drawn.join(pairs.select(F.col("place").alias("other"), F.col("f").alias("of"), F.col("g").alias("og")), "other").where(~F.col("f").eqNullSafe(F.col("of")) & ~F.col("f").eqNullSafe(F.col("og")))
        # a pair that several want, or that wants one itself, goes with the first of them
        met = written(met.select("place", "other", F.xxhash64(F.lit(turn), "place", "other").alias("h")), "wanted")
        first = met.select(F.explode(F.array("place", "other")).alias("p"), "h").groupBy("p").agg(F.min("h").alias("first"))
        own = met.join(first.select(F.col("p").alias("place"), F.col("first").alias("a")), "place").join(first.select(F.col("p").alias("other"), F.col("first").alias("b")), "other")
        pairs = _swapped(pairs, own.where("h = a and h = b").select("place", "other"))
        forget(met)
    return pairs.select(F.col("k").alias("source"), F.col("t").alias("target"), F.col("f").alias("source_frame"), F.col("g").alias("target_frame"))


def _swapped(pairs: DataFrame, swaps: DataFrame) -> DataFrame:
    """pairs in which place and other of each swap have each other's targets; a place is in one swap at most."""
    swaps = written(swaps, "swaps")
    both = swaps.union(swaps.select("other", "place"))
    given = both.join(pairs.select(F.col("place").alias("other"), F.col("t").alias("nt"), F.col("g").alias("ng")), "other").drop("other").withColumn("given", F.lit(True))
    new = lambda c: F.when(F.col("given"), F.col(f"n{c}")).otherwise(F.col(c)).alias(c)
    out = written(pairs.join(given, "place", "left").select("place", "k", "f", new("t"), new("g")), "pairs")
    forget(pairs), forget(swaps)
    return out


def sharded(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(index, F.lit(n)).cast("int"))


def manifest(df: DataFrame, key: str, arms: tuple[str, ...], conditions: tuple[str, ...], seed: int) -> DataFrame:
    """A row for each record, arm and condition with its primary key, seed and the hash of its fields."""
    cells = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(c).alias("condition"), F.lit(k).alias("condition_ix")) for a in arms for k, c in enumerate(conditions)])
    out = df.withColumn("cell", F.explode(cells)).select(key, "cell.*")
    out = out.withColumn("primary_key", F.concat_ws("|", "arm", "condition", F.col(key).cast("string"))).withColumn("row_seed", F.col(key) + F.lit(seed) * F.col("condition_ix"))
    return out.withColumn("row_hash", F.sha2(F.concat_ws("\n", "primary_key", F.col("row_seed").cast("string")), 256))
