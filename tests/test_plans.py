import re

import pytest

from tabulon.plans.queries import QUERIES
from tabulon.streaming.resumable import windowed_counts

#: Queries that meet a one-row aggregate, which Spark plans as a nested loop with a broadcast side.
ONE_ROW = {"bootstrap_battery_ci", "bootstrap_battery_histogram", "judge_bootstrap_ci", "judge_bootstrap_bh", "derangement_pairs", "derangement_validity", "unrelated_reference", "anchor_ladder", "ece_bins", "calibration_all_bins", "freeze_check", "unrelated_reference_ci"}
#: Queries with an Arrow function: Spark has no multinomial draws and no plug-ins.
ARROW = {"batch_scan", "bootstrap_battery_ci", "bootstrap_battery_histogram", "drift_bootstrap_ci", "judge_bootstrap_ci", "judge_bootstrap_bh", "echo_sensitivity_ci", "description_drift_ci", "unrelated_reference_ci"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert ("BroadcastNestedLoopJoin" in p) <= (name in ONE_ROW)
    assert bool(re.search("Python|Arrow|Pandas", p)) == (name in ARROW)


def test_scans_read_what_they_need(spark, sf):
    p = plan(QUERIES["accuracy_battery"](spark, sf))
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", p)[1].split(",")) == {"o_orderkey:bigint", "o_custkey:bigint", "o_totalprice:double"}
    p = plan(QUERIES["prefix_sample"](spark, sf))
    assert "LessThan(o_orderkey,200)" in p


def test_paired_outcomes_cost_one_shuffle_before_the_cells(spark, sf):
    p = plan(QUERIES["transition_decomposition"](spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2 and "Join" not in p


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:11:00", "b"), ("2024-01-01 02:00:00", "b")]
    src = spark.createDataFrame(rows, "t string, kind string").selectExpr("cast(t as timestamp) as t", "kind")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", "10 minutes", "10 minutes", ["kind"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.kind, r.n) for r in spark.sql("select * from w").collect()}
    assert got == {("a", 2), ("b", 1)}
