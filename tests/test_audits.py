"""Audits, formats, hashes and writers on small tables, beside values worked out by hand."""

import json
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulon.functions import hashing, text
from tabulon.operators import audits, classification
from tabulon.plans.queries import ORACLE, QUERIES
from tabulon.sources import readers, writers


def test_both_ways(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "v string")
    assert tuple(audits.both_ways(a, b, "left", "right").first()) == (4, 2, 1)
    assert tuple(audits.both_ways(a.limit(0), b.limit(0), "left", "right").first()) == (0, 0, 0)


def test_field_mismatches(spark):
    m = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    o = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = {r.k: r.found for r in audits.field_mismatches([("m", m), ("o", o), ("p", m)], "k", {"o": ["v"], "p": ["v"]}).collect()}
    assert got == {1: [], 2: ["o.v"], 3: ["o"]}


def test_ledger_of_repeated_keys(spark, tmp_path):
    """One row a file: keys that repeat on either side multiply nothing, and a null key or digest is one like any other."""
    files = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "3"), ("b", "1"), ("c", None), (None, "1")], "path string, sha string")
    ledger = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("c", None), (None, "1")], "path string, sha string")
    got = sorted(map(tuple, audits.ledger_status(files, ledger, "path", "sha").collect()), key=str)
    assert got == sorted([("a", "match"), ("a", "match"), ("a", "differs"), ("b", "unlisted"), ("c", "match"), (None, "match")], key=str)
    n = 40
    pages = pa.table({"page_id": pa.array([*range(n), None], pa.int64()), "url": [f"u{k % 4}" for k in range(n)] + [None], "html": [None if k % 13 == 1 else f"h{k % 3}" for k in range(n + 1)]})
    pq.write_table(pages, f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, QUERIES["ledger_lookup"](spark, str(tmp_path)).collect()), key=key) == sorted(con.sql(ORACLE["ledger_lookup"]).fetchall(), key=key)


def test_checks_fail_at_the_end(spark):
    counts = spark.createDataFrame([(3, 5)], "a long, b long")
    checks = audits.expected_counts(counts, {"a": F.lit(3), "b": F.lit(4)})
    assert {r.check: r.holds for r in checks.collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError, match="'b'"):
        audits.failed(checks)
    audits.failed(checks.where("check = 'a'"))


def test_appearance(spark, monkeypatch):
    monkeypatch.setattr(audits, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(rng.randrange(40), k) for k in rng.sample(range(1000), 200)]
    order = list(dict.fromkeys(c for c, _ in sorted(rows, key=lambda r: r[1])))
    got = {r.c: r.place for r in audits.appearance(spark.createDataFrame(rows, "c long, k long"), "c", "k").collect()}
    assert got == {c: i for i, c in enumerate(order)}


def test_policies(spark):
    df = spark.createDataFrame([("a", None), ("ab", "x")], "t string, u string")
    assert {tuple(r) for r in audits.column_policy(df, ["t"]).collect()} == {("t", True, 2), ("u", False, 1)}
    assert {tuple(r) for r in audits.token_policy(df, "t", ["a"], ["b"]).collect()} == {("a", "required", 2), ("b", "forbidden", 1)}
    assert audits.where_if_present(df, "none", "x").count() == 2 and audits.where_if_present(df, "u", "x").count() == 1


def test_formats(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("c")).first().c
    assert [show(text.fixed(F.lit(x), 2, s)) for x, s in ((1.005, False), (-0.001, True), (-0.001, False), (2.5, True), (-2.5, True))][1:] == ["0.00", "0.00", "+2.50", "-2.50"]
    assert show(text.thousands(F.lit(2653000))) == "2,653,000"
    assert show(text.interval(F.lit(0.5), F.lit(-0.25), F.lit(1.0), F.lit(7), 2)) == "0.50 [-0.25, 1.00]; n=7"
    assert [show(text.count_share(F.lit(k), F.lit(n))) for k, n in ((1, 8), (0, 0))] == ["1 (12.5%)", "0"]


def test_record_hash(spark):
    df = hashing.with_record_hash(spark.createDataFrame([(1, None), (2, "é\"")], "a long, b string"))
    status = lambda d: [r[0] for r in d.select(hashing.record_hash_status(d)).collect()]
    assert status(df) == ["valid", "valid"]
    assert status(df.withColumn("b", F.lit("x"))) == ["invalid", "invalid"]
    assert status(df.withColumn("record_sha256", F.lit(None).cast("string"))) == ["missing", "missing"]


def test_signatures(spark):
    cases = [(b"\x89PNG\r\n\x1a\n...", "a.png", "png", True), (b"\x89PNG\r\n\x1a\n...", "a.jpg", "png", False), (b"\xff\xd8\xff\xe0", "a.JPG", "jpeg", True), (b"MM\x00*", "a.tiff", "tiff", False), (b"<?xml version='1.0'?>\n<svg >", "a.svg", "svg", False), (b"text", "a.png", None, False), (b"", "png", None, False)]
    df = spark.createDataFrame([(c, n) for c, n, _, _ in cases], "c binary, n string")
    got = df.select(hashing.signature(F.col("c")), hashing.image_allowed(F.col("c"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(k, a) for _, _, k, a in cases]


def test_calibration_of_absent_classes(spark):
    p = spark.createDataFrame([(0, 0, 1, 0.95), (0, 1, 0, 0.85)], "gold int, pred int, correct int, confidence double")
    assert [(r.pred, r.n) for r in classification.expected_error_of_classes(p, 3).orderBy("pred").collect()] == [(0, 1), (1, 1), (2, 0)]
    table = classification.calibration_table(p).orderBy("bin").collect()
    assert len(table) == 10 and [r.n for r in table] == [0] * 8 + [1, 1] and table[0].accuracy is None
    all_ = classification.overall(p, 2).first()
    assert (all_.accuracy, all_.micro_precision) == (0.5, pytest.approx(0.5)) and all_.macro_recall == pytest.approx(0.25)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k long, v string")
    a = writers.delimited_digest(df, f"file://{tmp_path}/a", ["k"])
    assert a == writers.delimited_digest(df.orderBy("v"), f"file://{tmp_path}/b", ["k"]) != writers.delimited_digest(df.where("k > 1"), f"file://{tmp_path}/c", ["k"])
    with pytest.raises(ValueError):
        writers.delimited_digest(df.limit(0), f"file://{tmp_path}/d", ["k"])
    few = df.where("k < 2")
    writers.like_container(few, ["k"], f"{tmp_path}/list.json", [])
    writers.like_container(few, ["k"], f"{tmp_path}/map.json", {"meta": 1, "rows": []}, "rows")
    rows = [{"k": 0, "v": "v0"}, {"k": 1, "v": "v1"}]
    assert json.load(open(f"{tmp_path}/list.json")) == rows and json.load(open(f"{tmp_path}/map.json")) == {"meta": 1, "rows": rows}


def test_merged_parts(spark, tmp_path):
    writers.parts(spark.range(100).select(((F.col("id") * 37) % 100).alias("k")), f"file://{tmp_path}/p", "k", 30)
    got = sorted((int(r.part), r.position, r.k) for r in readers.merged_parts(spark, f"file://{tmp_path}/p").collect())
    assert [k for _, _, k in got] == list(range(100))
