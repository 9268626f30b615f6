import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabulon.sources import readers, writers
from tabulon.streaming import resumable

PAIR = StructType([StructField("k", StringType()), StructField("v", LongType())])


def test_delimited_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("a\tb\n1\tx\n2\t\n")
    rows = readers.delimited(spark, str(tmp_path / "t.tsv.gz"), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in rows] == [("1", "x"), ("2", None)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":"a","v":1}\n\n{"k":"b","v":2}\n{"k":"c","v"')
    assert readers.json_lines_tolerant(spark, str(tmp_path / "a.jsonl"), PAIR, "k").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), PAIR).collect()


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"meta": 1, "data": [{"k": "a"}, {"k": "b"}]}, indent=1))
    assert sorted(r.k for r in readers.json_document(spark, str(tmp_path / "d.json")).collect()) == ["a", "b"]
    (tmp_path / "m.jsonl").write_text('[{"k":"a","v":1},{"k":"b","v":2}]\n{"k":"c","v":3}\nnoise\n')
    assert sorted(r.k for r in readers.mixed_json(spark, str(tmp_path / "m.jsonl"), PAIR).collect()) == ["a", "b", "c"]
    text = (tmp_path / "m.jsonl").read_text().split("\n")
    assert all(f'"{r.k}"' in text[r.place - 1] for r in readers.mixed_json(spark, str(tmp_path / "m.jsonl"), PAIR).collect())


def test_shards_must_be_unique(spark, tmp_path):
    for d, rows in (("w0", ["a", "b"]), ("w1", ["c"])):
        (tmp_path / d).mkdir()
        (tmp_path / d / "records.jsonl").write_text("".join(json.dumps({"k": k, "v": 1}) + "\n" for k in rows))
    assert readers.shards(spark, str(tmp_path), PAIR, "k").count() == 3
    (tmp_path / "w1" / "records.jsonl").write_text('{"k":"a","v":1}\n')
    with pytest.raises(ValueError, match="unique"):
        readers.shards(spark, str(tmp_path), PAIR, "k")


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.md").write_text("# x\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n")
    assert [r.cells for r in readers.markdown_table(spark, str(tmp_path / "t.md"), 2).collect()] == [["a", "b"], ["1", "2"]]
    (tmp_path / "r.jsonl").write_text(json.dumps({"custom_id": "x", "response": {"body": {"choices": [{"message": {"content": "hi"}}]}}}) + "\nbad\n")
    assert [tuple(r) for r in readers.response_contents(spark, str(tmp_path / "r.jsonl")).collect()] == [("x", "hi")]
    (tmp_path / "e").mkdir()
    for n in (3, 12):
        (tmp_path / "e" / f"epoch_{n}.json").write_text("{}")
    assert readers.latest_epoch(spark, str(tmp_path / "e")) == 12
    assert readers.files(spark, str(tmp_path), ("e",)).count() == 2
    rows = spark.createDataFrame([("d/t.md",), ("d/none.md",)], "f string")
    assert readers.with_asset(rows, "f", readers.files(spark, str(tmp_path))).count() == 1


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 2}, "b": 1}))
    (tmp_path / "child.json").write_text(json.dumps({"_base": "base.json", "a": {"y": 3}}))
    assert readers.config(str(tmp_path / "child.json")) == {"a": {"x": 1, "y": 3}, "b": 1}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a_%")], "k int, v string")
    writers.delimited(df, str(tmp_path / "o"), ["k"], compression="gzip")
    assert readers.delimited(spark, str(tmp_path / "o"), ["k", "v"]).count() == 2
    with pytest.raises(ValueError, match="nothing"):
        writers.delimited(df.limit(0), str(tmp_path / "p"), ["k"])
    assert writers.markdown(df, ["k"]).splitlines()[2] == "| 1 | a_% |"
    assert writers.tex_table(df, ["k"]).splitlines()[1] == r"1 & a\_\% \\"
    writers.document(df, ["k"], str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())[0] == {"k": 1, "v": "a_%"}
    writers.parts(spark.range(10), str(tmp_path / "parts"), "id", 4)
    assert sorted(p.name for p in (tmp_path / "parts").glob("part=*")) == ["part=0", "part=1", "part=2"]
    writers.family(df, str(tmp_path / "fam"), ["k"])
    a, b = (spark.read.option("sep", s).option("header", True).csv(str(tmp_path / f"fam.{n}")) for n, s in (("tsv", "\t"), ("csv", ",")))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with pytest.raises(ValueError, match="lacks"):
        writers.rendered("@@ROW_0@@", ["x", "y"])
    assert writers.rendered("<@@ROW_0@@>", ["x"]) == "<x>"


def test_stream_resumes(spark, tmp_path):
    schema = StructType([StructField(c, StringType()) for c in ("primary_key", "row_hash", "status")])
    manifest = spark.createDataFrame([(f"k{i}", f"h{i}") for i in range(6)], "primary_key string, row_hash string")
    (tmp_path / "in").mkdir()
    put = lambda name, keys: (tmp_path / "in" / name).write_text("".join(json.dumps({"primary_key": f"k{i}", "row_hash": f"h{i}", "status": "success"}) + "\n" for i in keys))
    run = lambda: resumable.ingest(spark, str(tmp_path / "in"), schema, manifest, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    put("a.json", [0, 1])
    assert run()
    put("b.json", [1, 2, 3])  # k1 again, as after a crash
    assert run()
    assert sorted(r.primary_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k0", "k1", "k2", "k3"]


def test_cache_scores_each_key_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    score = lambda df: df.select("prompt_hash", F.length("prompt").alias("score"))
    tasks = spark.createDataFrame([("a", "xx"), ("a", "xx"), ("b", "yyy")], "prompt_hash string, prompt string")
    assert sorted(r.score for r in resumable.cached(tasks, cache, score).collect()) == [2, 2, 3]
    resumable.cached(tasks, cache, score).count()
    assert spark.read.parquet(cache).count() == 2
