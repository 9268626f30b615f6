"""Queries on pairs of texts: texts stay where they are read, and repeated ids meet as in SQL."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabulon.operators import blocks
from tabulon.plans.queries import ORACLE, QUERIES
from tests.conftest import SF
from tests.oracle import TABLES, assert_same


def documents(path, ids, most, vocabulary):
    """A table of random words beside the other test tables; every seventh text is blank or null."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    rnd = np.random.default_rng(7)
    texts = [(None if k % 2 else "  ") if k % 7 == 3 else " ".join(f"W{w}" if w % 5 == 0 else f"w{w}x" for w in rnd.integers(0, vocabulary, rnd.integers(1, most))) for k in range(len(ids))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": [f"src{k % 9}" for k in range(len(ids))], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), f"{path}/documents.parquet")
    return str(path), sum(len(t or "") for t in texts)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    return documents(tmp_path_factory.mktemp("large"), list(range(600)), 1500, 10**6)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    return documents(tmp_path_factory.mktemp("repeated"), [k // 2 if k < 60 else None if k % 31 == 0 else k for k in range(200)], 30, 40)[0]


def shuffled(spark):
    """Bytes that stages have written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("name", ["echo_sensitivity_ci", "description_drift_ci", "drift_bootstrap_ci"])
def test_texts_are_read_once(spark, large, name):
    """Means, counts and draws come from a table of scores."""
    plan = QUERIES[name](spark, large[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 1


#: Queries, and the share of the texts' characters that they may shuffle.
SHARE = {
    "token_f1_drift": 0.02, "drift_by_condition": 0.1, "paired_contrast_drift": 0.1, "description_ablation": 0.1, "anchor_ladder": 2.5,
}


@pytest.mark.parametrize("name", SHARE)
def test_texts_stay(spark, large, name):
    sf, size = large
    before = shuffled(spark)
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled(spark) - before < SHARE[name] * size


#: Queries with SQL, which joins texts by their ids: of an id that repeats, each text meets each source, and a null id meets none.
REPEATED = ["token_f1_drift", "drift_by_condition", "paired_contrast_drift", "description_ablation"]


@pytest.mark.parametrize("name", REPEATED)
def test_repeated_ids(spark, repeated, name):
    assert_same(QUERIES[name](spark, repeated), ORACLE[name], repeated)


def test_quartiles_of_drifts_hold_whatever_the_cuts(spark, repeated, monkeypatch):
    """Each evaluation of the cuts between parts finds other ones, as it may where sketches are merged in another order."""
    real = blocks.F.percentile_approx
    moved = blocks.F.udf(lambda cuts: [c + int.from_bytes(os.urandom(2)) / 2**18 for c in cuts], "array<double>")
    monkeypatch.setattr(blocks.F, "percentile_approx", lambda *x: moved(real(*x)))
    assert_same(QUERIES["drift_by_condition"](spark, repeated), ORACLE["drift_by_condition"], repeated)
