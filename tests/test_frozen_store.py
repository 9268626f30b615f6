"""A store under stream conditions: restarts, torn writes, foreign keys, other metadata."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators.store import StoreViolation
from tabulon.sources.logs import lines
from tabulon.streaming import frozen_store
from tests.test_texts import shuffled


def manifest(spark, n=10):
    return spark.createDataFrame([(f"k{i}", f"h{i}") for i in range(n)], "primary_key string, row_hash string")


def log(spark, folder, name, rows, torn=""):
    """A file as an append log has it; torn is what a crash left of the next line."""
    records = spark.createDataFrame(rows, "primary_key string, row_hash string, status string, attempt long, payload string")
    out = [r.value for r in frozen_store.with_hash(records).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect()]
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(("".join(line + "\n" for line in out) + torn).encode())


def rows(*keys, status="success", attempt=1):
    return [(f"k{i}", f"h{i}", status, attempt, f"é {i}") for i in keys]


def verdicts(df):
    return sorted((r.primary_key, r.attempt, r.verdict) for r in df.collect())


def test_restart_torn_write_and_foreign_key(spark, tmp_path):
    src, root = tmp_path / "log", str(tmp_path / "store")
    log(spark, src, "a.jsonl", rows(0, 1, 2), torn='{"primary_key": "k3", "row_ha')
    run = lambda n=10: frozen_store.ingest(spark, str(src), root, {"purpose": "test"}, manifest(spark, n))
    assert verdicts(run()) == [(f"k{i}", 1, "accepted") for i in range(3)]
    torn = spark.read.parquet(f"{root}/torn").collect()
    size = (src / "a.jsonl").stat().st_size
    assert [(r.line, r.byte_offset, r.value) for r in torn] == [(4, size - len('{"primary_key": "k3", "row_ha'), '{"primary_key": "k3", "row_ha')]
    # a second run sees nothing new; a third goes on, and remembers what entered
    assert len(verdicts(run())) == 3
    log(spark, src, "b.jsonl", [*rows(3, 4), *rows(1, attempt=2), ("zz", "h", "success", 1, "x"), ("k5", "other", "success", 1, "x"), *rows(6, status="error"), *rows(7, 7)])
    log(spark, src, "c.jsonl", [*rows(6, attempt=2), *rows(8, attempt=9), *rows(8, attempt=4), *rows(3, attempt=5)])
    got = [v for v in verdicts(run()) if v[0] not in ("k0", "k2")]
    assert got == sorted([("k1", 1, "accepted"), ("k1", 2, "duplicate_key"), ("k3", 1, "accepted"), ("k3", 5, "duplicate_key"), ("k4", 1, "accepted"), ("k5", 1, "row_hash_mismatch"), ("k6", 1, "not_successful"), ("k6", 2, "accepted"), ("k7", 1, "accepted"), ("k7", 1, "duplicate_key"), ("k8", 4, "accepted"), ("k8", 9, "duplicate_key"), ("zz", 1, "foreign_key")])
    with pytest.raises(StoreViolation, match="other metadata or manifest"):
        run(9)
    with pytest.raises(StoreViolation, match="other metadata or manifest"):
        frozen_store.ingest(spark, str(src), root, {"purpose": "another"}, manifest(spark))


def test_a_batch_that_runs_again_is_judged_once(spark, tmp_path):
    """A run that ended between its verdicts and its commit is done again; records move by one shuffle, and places are found only where a line is damaged."""
    src, root, n = tmp_path / "log", str(tmp_path / "store"), 1500
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1500))
    log(spark, src, "a.jsonl", [(f"k{i}", f"h{i}", "success", a, text()) for i in range(n) for a in (1, 2)])
    run = lambda: frozen_store.ingest(spark, str(src), root, {}, manifest(spark, n))
    before = shuffled(spark)
    want = sorted((f"k{i}", a, v) for i in range(n) for a, v in ((1, "accepted"), (2, "duplicate_key")))
    assert verdicts(run()) == want
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled(spark) - before < 1.5 * (src / "a.jsonl").stat().st_size
    for f in (tmp_path / "store" / "checkpoint" / "commits").iterdir():
        f.unlink()
    assert verdicts(run()) == want


def test_damage_is_not_repaired(spark, tmp_path):
    src, root = tmp_path / "log", str(tmp_path / "store")
    log(spark, src, "a.jsonl", rows(0, 1))
    one, two = (src / "a.jsonl").read_text().splitlines()
    changed = json.loads(one) | {"payload": "2"}
    (src / "a.jsonl").write_text(json.dumps(changed) + "\n" + two + "\n")
    assert verdicts(frozen_store.ingest(spark, str(src), root, {}, manifest(spark))) == [("k0", 1, "record_hash_mismatch"), ("k1", 1, "accepted")]
    (src / "b.jsonl").write_text(two[:30] + "\n" + two + "\n")
    with pytest.raises(StoreViolation, match="line 1, byte 0"):
        frozen_store.ingest(spark, str(src), root, {}, manifest(spark))


def test_lines_have_their_places(spark, tmp_path):
    data = {"a.txt": "one\ntwo é\n\nlast", "b.txt": "x\n" * 5000, "c.txt": "y\r\nz\n", "d.txt": "", "e.txt": "\n", "f.txt": "﻿mark\nend"}
    for name, text in data.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # several splits a file
    try:
        got = {}
        for r in lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.byte_offset, r.value, r.ended))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in data.items():
        raw = text.encode()
        want, at = [], 0
        for n, part in enumerate(raw.split(b"\n")):
            ended = at + len(part) < len(raw)
            if part or ended:
                want.append((n + 1, at, part.decode(), ended))
            at += len(part) + 1
        if name == "f.txt":  # the mark isn't read
            want = [(1, 0, "mark", True), (2, 5, "end", False)]
        assert sorted(got.get(name, [])) == want, name
