"""Orders and running values by blocks, and draws by parts, beside brute force."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from tabulon.operators import blocks, bootstrap, summary


def events(n=400, seed=3):
    rnd = random.Random(seed)
    keys = rnd.sample(range(-500, 5000), n)
    return [(rnd.choice(["hot", "hot", "hot", "a", None]), k, rnd.choice([None, *[float(x) for x in range(12)]])) for k in keys]


@pytest.mark.parametrize("block", [1, 64, 1 << 16])
def test_rank(spark, block):
    rows = events()
    got = {r.k: r.place for r in blocks.with_rank(spark.createDataFrame(rows, "g string, k long, v double"), ["g"], "k", "place", block).collect()}
    groups = defaultdict(list)
    for g, k, _ in rows:
        groups[g].append(k)
    assert got == {k: i for ks in groups.values() for i, k in enumerate(sorted(ks))}


@pytest.mark.parametrize("block", [1, 64, 1 << 16])
def test_stopped_early(spark, block):
    rows = [*events(), ("none", 9000, None), ("none", 9001, None), ("none", 9002, None), ("none", 9003, None)]
    got = {r.g: (r.best, r.stopped_at) for r in blocks.stopped_early(spark.createDataFrame(rows, "g string, k long, v double"), "g", "k", "v", 3, block).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        best, since, stop = None, 0, None
        for i, (k, v) in enumerate(sorted(((k, v) for h, k, v in rows if h == g), key=lambda x: x[0])):
            if v is not None and (best is None or v >= best):
                best, since = v, i
            if i - since >= 3 and stop is None:
                stop = k
        want[g] = (best, stop)
    assert got == want


def test_all_but_newest(spark):
    rows = [(g, None if k % 17 == 0 else k // 3, k) for g, k, _ in events()] + [("few", 1, 9000)]
    got = {(r.g, r.k) for r in blocks.all_but_newest(spark.createDataFrame(rows, "g string, t long, k long"), "g", ["t", "k"], 3).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=True)
        want |= {(g, r[2]) for r in own[3:]}
    assert got == want


@pytest.mark.parametrize("parts", [2, 256])
def test_quartiles(spark, parts):
    rows = events() + [("one", 1, 4.0), ("two", 1, 4.0), ("two", 2, 5.0), ("empty", 3, None)]
    got = {r.g: r.q for r in blocks.quartiles(spark.createDataFrame(rows, "g string, k long, v double"), "v", ["g"], parts).collect()}
    own = defaultdict(list)
    for g, _, v in rows:
        if v is not None:
            own[g].append(v)
    assert set(got) == set(own) and all(np.allclose(got[g], np.quantile(vs, [0.25, 0.5, 0.75])) for g, vs in own.items())


def test_quartiles_hold_whatever_the_cuts(spark, monkeypatch):
    """Sketches merged in another order cut elsewhere: here each evaluation of the cuts finds other ones."""
    real = blocks.F.percentile_approx
    moved = blocks.F.udf(lambda cuts: [c + int.from_bytes(os.urandom(2)) / 64 for c in cuts], "array<double>")
    monkeypatch.setattr(blocks.F, "percentile_approx", lambda *x: moved(real(*x)))
    rows = [(g, float(k)) for g, n in (("a", 4001), ("b", 2222)) for k in range(n)]
    got = {r.g: r.q for r in blocks.quartiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], 16).collect()}
    assert got == {"a": [1000.0, 2000.0, 3000.0], "b": [555.25, 1110.5, 1665.75]}


def test_numeric_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 1), ("a", None, 2)], "g string, v double, c long")
    assert [tuple(r) for r in summary.numeric(df, "v", ["g"], "c").collect()] == [(None, 2, 1, 2.0, 2.0, 1.414214, 1.5, 2.5)]


def test_draws_by_parts(spark):
    """A column for each cluster shows the counts: whole, as many as clusters, spread as a multinomial's, the same again, whatever the parts' order."""
    n, r = 600, 400
    one = [("g", c, *[float(c == k) for k in range(0, n, 20)], 1.0) for c in range(n)] + [("h", 5, *[1.0] * 30, 1.0), (None, 1, *[1.0] * 31), ("g", None, *[1.0] * 31)]
    names = [f"c{k}" for k in range(0, n, 20)] + ["n"]
    df = spark.createDataFrame(one, "g string, c long, " + ", ".join(f"{x} double" for x in names))
    run = lambda d: {(x.g, x.rep): tuple(x)[2:] for x in bootstrap.multinomial_replicates(d, ["g"], "c", names, r, part_size=150).collect()}
    got = run(df)
    assert len(got) == 2 * r and got == run(df.repartition(7, "c"))
    assert all(v[-1] == (n if g == "g" else 1) for (g, _), v in got.items()) and all(v == (1.0,) * 31 for (g, _), v in got.items() if g == "h")
    counts = np.array([got["g", k][:-1] for k in range(r)])
    assert np.array_equal(counts, counts.round()) and len({tuple(c) for c in counts}) == r
    assert abs(counts.mean() - 1) < 0.05 and abs(counts.var() - (1 - 1 / n)) < 0.08
    assert abs((counts == 0).mean() - np.exp(-1)) < 0.02 and abs((counts >= 2).mean() - (1 - 2 * np.exp(-1))) < 0.02
    pairs = np.cov(counts.T)[~np.eye(30, dtype=bool)]
    assert abs(pairs.mean() + 1 / n) < 0.01
