"""Release audits, printed numbers, pixel algebra, patches and the catalogue of pairs on small cases."""

import hashlib
import os
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulon.functions import images, printed
from tabulon.operators import joins, pairs, release
from tabulon.plans.queries import ORACLE, QUERIES
from tests.conftest import SF
from tests.oracle import TABLES, assert_same
from tests.test_texts import shuffled

PNG = bytes.fromhex("89504e470d0a1a0a") + b"synthetic"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def audited(spark, tree, folder, pictures=(), manifest=None, known=(), **policy):
    for name, b in tree.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b)
    manifest = tree if manifest is None else manifest
    m = spark.createDataFrame([(n, sha(b), len(b)) for n, b in manifest.items()], "path string, sha256 string, bytes long")
    p = spark.createDataFrame([(n, h, c) for n, h, c in pictures], "path string, sha256 string, classification string")
    k = spark.createDataFrame([(h,) for h in known], "sha256 string") if known else None
    found = release.audit(release.files_of(spark, str(folder)), m, p, k, release.Policy(**policy))
    return sorted((r.path, r.kind, r.line) for r in found.collect())


def test_trees_against_a_manifest(spark, tmp_path):
    tree = {"a.txt": b"one", "b/c.py": b"x = 1\n", "b/d.bin": b"\x00\xff\x80", "empty.md": b""}
    assert audited(spark, tree, tmp_path) == []
    (tmp_path / "extra.txt").write_bytes(b"?")
    (tmp_path / "a.txt").write_bytes(b"two")
    found = audited(spark, {}, tmp_path, manifest=tree | {"gone.txt": b"x"})
    assert found == [("a.txt", "hash_or_size", 0), ("extra.txt", "unexpected", 0), ("gone.txt", "missing", 0)]


def test_pictures_must_be_listed_by_path_and_hash(spark, tmp_path):
    tree = {f"{d}/x{n}": b for d in ("data", ".venv") for n, b in ((".dat", PNG), (".txt", bytes.fromhex("ffd8ff") + b"j"), ("", b"RIFF0000WEBPs"))}
    tree |= {"ok.png": PNG, "odd.png": PNG + b"!", "thesis/records/C/r.dat": PNG + b"r", "moved.dat": PNG + b"known", "fake.png": b"no picture"}
    listed = [("ok.png", sha(PNG), "SYNTHETIC"), ("odd.png", sha(PNG), "SYNTHETIC"), ("thesis/records/C/r.dat", sha(PNG + b"r"), "SYNTHETIC"), ("moved.dat", sha(PNG + b"known"), "SYNTHETIC"), ("lost.png", sha(PNG), "SYNTHETIC"), ("fake.png", sha(b"no picture"), "EXEMPT")]
    found = audited(spark, tree, tmp_path, listed, known=[sha(PNG + b"known")], roots=("thesis/records/",))
    assert found == sorted([(n, "forbidden_picture", 0) for n in tree if n != "ok.png"] + [("lost.png", "picture_missing", 0)])


def test_secrets_and_private_paths_are_named_not_shown(spark, tmp_path):
    token = "gh" + "p_" + "SYNTHETIC" * 5
    tree = {"a.py": f"x = 1\ny = '{token}'\n".encode(), "b.md": b"see /home/someone/x\n", "c.txt": b"GPU-" + b"0a" * 16, "sub/.env": b"K=1", "d.jsonl": b"{}", "big.bin": b"0" * 150}
    found = audited(spark, tree, tmp_path, most_bytes=100)
    assert found == sorted([("a.py", "github_token", 2), ("b.md", "private_absolute_path", 0), ("c.txt", "private_device_uuid", 0), ("sub/.env", "credential_filename", 0), ("sub/.env", "unreadable", 0), ("d.jsonl", "forbidden_suffix", 0), ("big.bin", "oversize", 0)])
    m = spark.createDataFrame([], "path string, sha256 string, bytes long")
    p = spark.createDataFrame([], "path string, sha256 string, classification string")
    shown = [r.detail for r in release.audit(release.files_of(spark, str(tmp_path)), m, p).collect()]
    assert not any(token in d for d in shown) and sha(token.encode())[:12] in shown
    files = release.files_of(spark, str(tmp_path)).limit(0)
    assert release.audit(files, m, p).count() == 0


def test_numbers_of_rendered_rows(spark):
    rows = [(1, r"\textbf{plain} & 2,653 & 1,203 & 0.4535 & 45.3\% & +0.12 [-0.01, 0.25]; n=2,653 \\"), (2, r"\toprule"), (3, "| arm | 12 | -3 | 1.5.2 | 1,23 | 7% |"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "k int, line string")
    got = [(r.cell, r.part, r.kind, r.value, r.digits) for r in printed.tokens(df, ["k"]).where("k = 1").orderBy("cell", "part").collect()]
    d = Decimal
    assert got == [(1, 0, "integer", d(2653), 0), (2, 0, "integer", d(1203), 0), (3, 0, "decimal", d("0.4535"), 4), (4, 0, "percent", d("45.3"), 1), (5, 0, "mean", d("0.12"), 2), (5, 1, "low", d("-0.01"), 2), (5, 2, "high", d("0.25"), 2), (5, 3, "count", d(2653), 0)]
    bars = [(r.cell, r.kind, r.value) for r in printed.tokens(df, ["k"], sep="|").orderBy("cell").collect()]
    assert bars == [(1, "integer", d(12)), (2, "integer", d(-3)), (5, "percent", d(7))]


def test_rates_are_those_of_their_integers(spark):
    rows = [("a", "x & 2653 & 1203 & 0.4534 \\\\"), ("b", "x & 2653 & 1203 & 0.4535"), ("c", "x & 8 & 1 & 0.13"), ("d", "x & 8 & 1 & 0.12"), ("e", "x & 0 & 0 & 0.0000"), ("f", "x & n & 1 & 0.5000"), ("g", "x & 3 & 2 & 0.667"), ("h", "x & 3 & 2 & 0.66")]
    got = {r.k: r.holds for r in printed.ratio_checks(spark.createDataFrame(rows, "k string, line string"), ["k"], [(3, 2, 1)]).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False, "g": True, "h": False}  # a tie has two nearest rates
    lines = spark.createDataFrame([("a", "5 & 5 & 6 & 0.7000")], "k string, line string")
    left = printed.unaccounted(printed.tokens(lines, ["k"]), spark.createDataFrame([("a", 6), ("b", 5)], "k string, value long"), ["k"])
    assert [tuple(r) for r in left.collect()] == [("a", 5, 2)]


@pytest.mark.parametrize("channels", [1, 3])
def test_pixels_under_conditions(spark, channels):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 30, channels))
    df = spark.createDataFrame([(image.ravel().tolist(), 30, 5), ([1, 2, 3], 2, 5), ([], 2, 5), (None, 2, 5)], "v array<int>, w int, seed long")
    under = lambda c: [r[0] for r in df.select(images.pixels_under(F.col("v"), F.col("w"), c, F.col("seed"), channels)).collect()]
    shape = lambda v: np.array(v).reshape(image.shape)
    assert (shape(under("source")[0]) == image).all() and (shape(under("mirror")[0]) == image[:, ::-1]).all() and set(under("grey")[0]) == {128}
    assert under("mirror")[1:] == [None, [], None]
    mask = shape(under("mask")[0])
    kept = (mask == image).all(axis=2)
    assert 0.4 < kept.mean() < 0.6 and not mask[~kept].any() and under("mask") == under("mask")
    noise = shape(under("noise")[0]) - image
    inside = (image > 100) & (image < 156)
    assert abs(noise[inside].mean()) < 15 and 50 < noise[inside].std() < 80 and 0 <= shape(under("noise")[0]).min() and shape(under("noise")[0]).max() <= 255
    with pytest.raises(ValueError):
        images.pixels_under(F.col("v"), F.col("w"), "blur", F.col("seed"))


def test_patches_by_array_keys(spark):
    records = spark.createDataFrame([(1, ["a", "b"], 0, "old"), (2, ["a,b"], 0, "old"), (3, ["a", None], 1, " new "), (4, None, 0, "x"), (5, ["a", "b"], None, "x"), (6, [""], 0, None)], "id int, c array<string>, l int, v string")
    source = spark.createDataFrame([(["a", "b"], 0, "first", "old", 1), (["a", "b"], 0, "last", "old", 9), (["a", "b"], 0, "mid", "no", 5), (["a", None], 1, "new", "other", 1), (None, 0, "never", "x", 1), ([""], 0, "filled", None, 1)], "c array<string>, l int, new string, old string, o int")
    got = {r.id: (r.v, r.status, r.overwritten, r.agreed) for r in joins.patched(records, source, ["c", "l"], "v", "new", "old", "o").collect()}
    assert got == {1: ("last", "changed", 2, True), 2: ("old", "miss", None, None), 3: (" new ", "unchanged", 0, False), 4: ("x", "miss", None, None), 5: ("x", "miss", None, None), 6: ("filled", "changed", 0, False)}


def test_catalogue_numbers_jobs_in_their_order(spark):
    texts = [(a, k, r, "f", c, u, "" if (r, c, u) == (1, "grey", "raw") else f"{r}{c}{u}") for k, (a, r) in enumerate([("y", 2), ("x", 1)]) for c in ("source", "grey") for u in ("raw", "final")]
    spec = [("s2", "n1", "grey", "source", "grey", "raw", None), ("s2", "n2", "grey", "source", "grey", "final", None), ("s1", "n3", "g", "source", "grey", "final", ("x",))]
    ring = spark.createDataFrame([(1, 2), (2, 1)], "source int, target int")
    got = pairs.catalogue(spark.createDataFrame(texts, "arm string, arm_ix int, record_id int, frame_id string, condition string, unit string, text string"), spec, ring)
    rows = sorted(((r.job_index, r.analysis, r.arm, r.record_id) for r in got.collect()), key=lambda r: (r[0] is None, r[0]))
    assert rows == [(0, "n1", "y", 2), (1, "n2", "y", 2), (2, "n2", "x", 1), (3, "n3", "x", 1), (4, "unrelated_raw", "y", 2), (5, "unrelated_raw", "x", 1), (None, "n1", "x", 1)]
    counts = {(r.analysis, r.arm): (r.pairs, r.dropped) for r in pairs.catalogue_counts(got).collect()}
    assert counts["n1", "x"] == (0, 1) and counts["n1", "y"] == (1, 0)


def test_provenance_shuffles_a_row_a_frame(spark, tmp_path):
    """A frame is one row whatever the cells that it is in, and null keys, frames and strata are as in SQL."""
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    n = 9000
    pq.write_table(pa.table({"o_orderkey": pa.array([None if k == 7 else k - 4 for k in range(n)], pa.int64()), "o_custkey": pa.array([None if k % 50 == 3 else k // 2 for k in range(n)], pa.int64()), "o_orderpriority": [None if k % 9 == 1 else f"p{k % 5}" for k in range(n)], "o_totalprice": [k * 7.5 for k in range(n)]}), f"{tmp_path}/orders.parquet")
    before = shuffled(spark)
    QUERIES["cell_provenance"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled(spark) - before < 60 * n
    assert_same(QUERIES["cell_provenance"](spark, str(tmp_path)), ORACLE["cell_provenance"], str(tmp_path))
