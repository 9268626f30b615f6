"""The prompt cache, random derangements, numbering by ranges, joins with hot keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.functions.hashing import set_digest
from tabulon.operators import blocks, joins, sampling
from tabulon.operators.prompt_cache import PromptCache
from tabulon.operators.store import StoreViolation
from tabulon.plans.streams import stand_in


def prompts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "prompt string")


def test_what_is_known_is_not_asked_again(spark, tmp_path):
    asked = []

    def score(df):
        asked.append(sorted(r.prompt for r in df.collect()))
        return stand_in(df)

    cache = lambda revision="1", **kw: PromptCache(spark, str(tmp_path), "m", revision, **{"max_length": 64} | kw)
    one = cache()
    assert one.ask(prompts(spark, "a", "b", "a", None), score) == 2
    assert one.ask(prompts(spark, "b", "c"), score) == 1
    assert cache().ask(prompts(spark, "a", "b", "c"), score) == 0
    assert cache("2").ask(prompts(spark, "a", "b", "c"), score) == 3  # another revision scores all
    assert asked == [["a", "b"], ["c"], ["a", "b", "c"]]
    with pytest.raises(StoreViolation, match="max_length"):
        cache(max_length=128)
    # a job that runs twice, as if its first output hadn't been seen, replaces it
    before = sorted(map(tuple, one.answers().collect()))
    empty = PromptCache(spark, str(tmp_path / "again"), "m", "1")
    empty.ask(prompts(spark, "a", "b"), score)
    known, empty.answers = empty.answers, lambda: known().limit(0)
    assert empty.ask(prompts(spark, "a", "b"), score) == 2
    empty.answers = known
    assert empty.answers().count() == 2 and spark.read.option("recursiveFileLookup", True).parquet(f"{empty.path}/answers").count() == 2
    assert [r for r in before if r[0] in {x.prompt_hash for x in empty.answers().collect()}] == sorted(map(tuple, empty.answers().collect()))
    # answers that differ don't pass
    spark.createDataFrame([(before[0][0], 9, "other")], "prompt_hash string, prediction int, raw string").write.parquet(f"{one.path}/answers/other")
    with pytest.raises(Exception, match="answers differ"):
        one.answers().collect()


@pytest.mark.parametrize("most", [1 << 17, 3])
def test_two_look_ups_a_row(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(joins, "KEY_ROWS", most)
    cache = PromptCache(spark, str(tmp_path), "m", "1")
    cache.ask(prompts(spark, *(f"p{k}" for k in range(9))), stand_in)
    known = {r.prompt: r.prediction for r in stand_in(prompts(spark, *(f"p{k}" for k in range(9))).withColumn("prompt_hash", F.sha2("prompt", 256)).select("prompt_hash", "prompt")).join(prompts(spark, *(f"p{k}" for k in range(9))).withColumn("prompt_hash", F.sha2("prompt", 256)), "prompt_hash").collect()}
    rows = [(k, "p0", f"p{k % 12}" if k % 5 else None) for k in range(40)]  # p0 is hot, p9 to p11 were never asked
    got = {r.id: tuple(r)[3:] for r in cache.looked_up(spark.createDataFrame(rows, "id int, a string, b string"), "id", {"x": "a", "y": "b"}).collect()}
    for k, a, b in rows:
        assert got[k] == (known[a], known[a] is None, known.get(b), None if b is None else known.get(b) is None)


@pytest.mark.parametrize("sizes", [[5, 5], [50, 20, 19, 10, 1], [2] * 40])
def test_random_derangement(spark, sizes):
    rows = [(k, f"f{f}" if f else None) for k, f in enumerate(f for f, n in enumerate(sizes) for _ in range(n))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, f string")
    got = [tuple(r) for r in sampling.random_derangement(df, "k", "f", 7).collect()]
    frame = dict(rows)
    assert sorted(r[0] for r in got) == sorted(r[1] for r in got) == sorted(frame)
    assert all(frame[s] == a and frame[t] == b and a != b for s, t, a, b in got)
    if len(sizes) > 30:
        assert sorted(got) == sorted(tuple(r) for r in sampling.random_derangement(df.repartition(3), "k", "f", 7).collect())
        assert sorted(got) != sorted(tuple(r) for r in sampling.random_derangement(df, "k", "f", 8).collect())


def test_maps_that_cannot_be(spark):
    df = spark.createDataFrame([(k, "a" if k < 6 else "b") for k in range(11)], "k long, f string")
    with pytest.raises(sampling.Infeasible, match="6 of 11"):
        sampling.random_derangement(df, "k", "f", 1)
    with pytest.raises(Exception, match="no derangement"):
        sampling.derangement(df.select("k", (F.col("f") == "a").cast("int").alias("f")), "k", "f").collect()
    assert sampling.random_derangement(df.limit(0), "k", "f", 1).count() == 0


def test_targets_are_spread(spark):
    """Targets of one frame's sources come from all other frames, about as often as these have rows."""
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("f"))
    n = Counter((r.source_frame, r.target_frame) for r in sampling.random_derangement(df, "k", "f", 3).collect())
    assert set(n) == {(a, b) for a in "012" for b in "012" if a != b} and min(n.values()) > 400


def test_numbered(spark):
    rows = [(random.Random(k).randint(-50, 50), k) for k in range(300)] + [(None, -1)]
    got = {(r.a, r.b): r.place for r in blocks.numbered(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "place").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [got[r] for r in want] == list(range(len(rows)))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    left = spark.createDataFrame([(1, k) for k in range(20)] + [(2, 1), (3, 1), (None, 5)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, w string")
    want = Counter(tuple(r) for r in left.join(right, "k", how).collect())
    assert Counter(tuple(r) for r in joins.spread_join(left, right, ["k"], how, 5).select("k", "v", "w").collect()) == want


def test_set_digest(spark):
    digest = lambda *values: spark.createDataFrame([(v,) for v in values], "v string").repartition(3).agg(set_digest(F.col("v")).alias("d")).first().d
    assert digest("a", "b", "c") == digest("c", "a", "b", None) != digest("a", "b", "b") != digest("a", "b")
