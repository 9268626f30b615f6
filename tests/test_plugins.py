import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabulon.functions import images, text
from tabulon.operators import scorers
from tabulon.sources import runs


def test_scorer_sees_each_pair_once(spark):
    df = spark.createDataFrame([("a b", "a b"), ("a b", "a b"), ("a", "c"), (None, "x")], "left string, right string")

    def make():
        seen = set()

        def score(refs, cands):
            for p in zip(refs, cands, strict=True):
                assert p not in seen
                seen.add(p)
            return [float(r == c) for r, c in zip(refs, cands, strict=True)]

        return score

    got = sorted(((r.left, r.score) for r in scorers.scored(df, make).collect()), key=str)
    assert got == [(None, None), ("a b", 1.0), ("a b", 1.0), ("a", 0.0)] or sorted(map(str, got)) == sorted(map(str, [("a b", 1.0), ("a b", 1.0), ("a", 0.0), (None, None)]))


def test_choose(spark):
    df = spark.createDataFrame([("x y", ["y", "x y"]), ("x", ["x", "x"]), ("q", ["x", "y"]), (None, ["x"])], "p string, c array<string>")
    assert [r[0] for r in df.select(scorers.choose(F.col("p"), F.col("c"))).collect()] == [1, 0, None, None]


def test_images(spark):
    pixels = np.arange(2 * 4 * 3, dtype=np.uint8).reshape(2, 4, 3)
    rows = [(bytearray(pixels.tobytes()), 4, c, 7) for c in ("source", "grey", "mirror", "mask", "noise")] + [(bytearray(b"12345"), 4, "grey", 1), (None, 4, "grey", 1)]
    df = spark.createDataFrame(rows, "b binary, w int, c string, s long")
    got = [r[0] for r in df.select(images.image_under("b", "w", "c", "s")).collect()]
    assert bytes(got[0]) == pixels.tobytes() and set(bytes(got[1])) == {128} and bytes(got[2]) == pixels[:, ::-1].tobytes()
    assert all(a in (0, b) for a, b in zip(bytes(got[3]), pixels.tobytes(), strict=True)) and bytes(got[4]) != pixels.tobytes()
    assert bytes(got[4]) == images.construct(pixels, "noise", 7).tobytes() and got[5] is None and got[6] is None


def test_torn_tail(spark, tmp_path):
    schema = StructType([StructField("k", StringType()), StructField("v", LongType())])
    (tmp_path / "a.jsonl").write_text('{"k":"a","v":1}\n{"k":"b","v":2}\n{"k":"c","v"')
    ok, cut = runs.torn(spark, str(tmp_path / "a.jsonl"), schema)
    assert sorted(r.k for r in ok.collect()) == ["a", "b"] and [r.value for r in cut.collect()] == ['{"k":"c","v"']
    (tmp_path / "b.jsonl").write_text('{"k":"a","v"\n{"k":"b","v":2}\n')
    with pytest.raises(Exception, match="no record"):
        runs.torn(spark, str(tmp_path / "b.jsonl"), schema)[0].collect()


def test_run_folder(spark, tmp_path):
    path = runs.start(str(tmp_path), {"b": 1, "a": 2}, spark)
    made = json.loads(open(f"{path}/run.json").read())
    assert made["config_sha256"] == runs.config_hash({"a": 2, "b": 1}) and made["spark"] == spark.version


def test_clean_generated(spark):
    df = spark.createDataFrame([("System: x\n\n hello \nSystem again",), ("System only",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_generated(F.col("t"), ("System",))).collect()] == ["hello System again", "System only", "", None]
