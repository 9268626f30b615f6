import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import accuracy, bootstrap, classification, integrity, joins, ranking, sampling, store, summary

#: Transition counts of two cells, 2,653 records each, and what follows from them.
GOLDEN = [("plain", "grey", 1151, 984, 131, 387, 0.8047, 0.4832, 1115, -853), ("point_desc", "mirror", 2050, 113, 86, 404, 0.8153, 0.8051, 199, -27)]


@pytest.mark.parametrize("cell", GOLDEN)
def test_count_expansion(spark, cell):
    arm, cond, cc, cw, wc, ww, source, acc, churn, net = cell
    rows, k = [], 0
    for n, s, c in ((cc, 1, 1), (cw, 1, 0), (wc, 0, 1), (ww, 0, 0)):
        for _ in range(n):
            rows += [(arm, "source", k, k % 2400, s), (arm, cond, k, k % 2400, c)]
            k += 1
    p = spark.createDataFrame(rows, "arm string, condition string, record_id int, frame_id int, correct int")
    b = {r.condition: r for r in accuracy.battery(p).collect()}
    assert (round(b["source"].accuracy, 4), round(b[cond].accuracy, 4), b[cond].n, b[cond].frames) == (source, acc, 2653, 2400)
    t = accuracy.transitions(p).first()
    assert (t.cc, t.cw, t.wc, t.ww, t.churn, t.net, t.identity_holds) == (cc, cw, wc, ww, churn, net, True)


def test_ties_have_ranks_of_their_own(spark):
    df = spark.createDataFrame([("a", "x", 0.5, 1), ("a", "y", 0.5, 0), ("a", "z", 0.9, 2)], "arm string, c string, acc double, o int")
    got = {r.c: r["rank"] for r in ranking.ranked(df, "arm", F.desc("acc"), F.asc("o")).collect()}
    assert got == {"z": 1, "y": 2, "x": 3}


def test_step_up(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "k int, p double")
    got = {r.k: round(r.adjusted, 12) for r in ranking.step_up(df, "p", 3, "k").collect()}
    assert got == {0: 0.03, 1: 0.04, 2: 0.04}


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (1.0,)], "c double")
    assert [r[0] for r in df.select(classification.bin_of(F.col("c"), 10)).collect()] == [-1, 0, 1, 9]


def test_summary_of_one_and_none(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", None, 2)], "g string, v double, c int")
    got = summary.numeric(df, "v", ["g"], "c").collect()
    assert [(r.g, r.n, r.sd) for r in got] == [("a", 1, 0.0)]


def test_dense_index(spark):
    keys = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(k,) for k in [*keys, *keys[:50], None]], "k long")
    got = {r.k: r.ix for r in bootstrap.dense_index(df, "k").collect()}
    assert sorted(got.values()) == list(range(700))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(keys, key=lambda k: (k % 256, k))


def test_bootstrap_of_equal_clusters_is_a_point(spark):
    sums = spark.createDataFrame([(k, 4, 3) for k in range(50)], "c long, n long, s long")
    r = bootstrap.interval(bootstrap.multinomial_replicates(sums, [], "c", ["n", "s"], 40), {"m": F.try_divide("s", "n")}).first()
    assert (r.low, r.high, r.replicates) == (0.75, 0.75, 40)


@pytest.mark.parametrize(("total", "percent", "want"), [(26534, 10, 2653), (212923, 5, 10646)])
def test_quotas(total, percent, want):
    sizes = {k: total // 4 + (k < total % 4) for k in range(4)}
    q = sampling.quotas(sizes, {k: k for k in range(4)}, int(total * percent / 100))
    assert sum(q.values()) == want and max(q.values()) - min(q.values()) <= 1


def test_balanced_counts_null_as_a_class(spark):
    df = spark.createDataFrame([(None if k % 3 == 0 else "a" if k % 3 == 1 else "b", k) for k in range(90)], "label string, ix int")
    got = sampling.balanced(df, "label", "ix", 20).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {None: 6, "a": 6, "b": 6}


def test_derangement(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.choice(range(9))) for k in range(500)], "k long, f long")
    got = sampling.derangement(df, "k", "f").collect()
    assert len(got) == 500 == len({r.source for r in got}) == len({r.target for r in got})
    assert all(r.source != r.target and r.source_frame != r.target_frame for r in got)


def test_shards_that_overlap_are_told(spark):
    parent = spark.range(12).select(F.col("id").alias("k"))
    bad = sampling.sharded(parent, "k", 3).union(spark.createDataFrame([(3, 1), (99, 2)], "k long, shard int"))
    got = {r.shard: (r.n, r.shared, r.foreign) for r in integrity.shard_audit(bad, parent, "k").collect()}
    assert got == {0: (4, 1, 0), 1: (5, 1, 0), 2: (5, 0, 1)}


def test_previous_other(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "c"), (5, "a")], "ix long, k string")
    got = {r.ix: r.other for r in joins.previous_other(df, "ix", "k", 2).collect()}
    assert got == {0: None, 1: None, 2: "b", 3: "a", 4: "a", 5: "c"}


def test_store(spark, tmp_path):
    manifest = spark.createDataFrame([(f"k{i}", f"h{i}") for i in range(10)], "primary_key string, row_hash string")
    batch = lambda rows: spark.createDataFrame(rows, "primary_key string, row_hash string, status string")
    path, errors = str(tmp_path / "store"), str(tmp_path / "errors")
    assert store.append(batch([(f"k{i}", f"h{i}", "success") for i in range(3)]), manifest, path) == 3
    for bad in ([("k0", "h0", "success")], [("x", "h", "success")], [("k4", "other", "success")], [("k5", "h5", "success"), ("k5", "h5", "success")]):
        with pytest.raises(store.StoreViolation):
            store.append(batch(bad), manifest, path)
    assert store.append(batch([("k6", "h6", "error"), ("k7", "h7", "success")]), manifest, path, errors) == 1
    assert spark.read.parquet(errors).count() == 1
    a = store.audit(manifest, store.read(spark, path, batch([]))).first()
    assert (a.expected, a.actual, a.missing, a.unexpected, a.exact) == (10, 4, 6, 0, False)
