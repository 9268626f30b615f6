import hashlib
import random

import corpus_pipeline
from tabulon.llm.common import written

from . import odd


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    item = odd.prose(rng, 30)
    shared = odd.prose(rng, 60)
    near = odd.prose(rng, 400)
    data = [(k, odd.prose(rng, 120)) for k in range(40)]
    data += [(50, near), (51, near), (52, near.replace(near.split()[200], "zzz", 1))]  # a group
    data += [(60, f"{odd.prose(rng, 60)} {shared} {odd.prose(rng, 60)}"), (61, f"{odd.prose(rng, 60)} {shared} {odd.prose(rng, 60)}")]  # a passage
    data += [(70, f"{odd.prose(rng, 50)} {item} {odd.prose(rng, 50)}")]  # a leak
    data += [(80, "!!! ###"), (81, None), (82, "")]  # no language
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    ids, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf), "test")
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "BPE encoding":
            assert now.columns == docs.columns
    every = {k for k, _ in data}
    assert every - ids["language ID"] == {80, 81, 82}
    assert ids["language ID"] - ids["SimHash near-dedup"] == {51, 52}
    assert ids["suffix-array dedup"] == ids["SimHash near-dedup"]
    assert ids["suffix-array dedup"] - ids["benchmark decontamination"] == {70}
    assert ids["BPE encoding"] == ids["benchmark decontamination"]
    sums = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    text = dict(data)
    assert set(sums) == ids["BPE encoding"]
    cut = text[61].replace(" " + shared + " ", "")
    for k in sums:
        kept = text[k] if k != 61 else cut
        assert sums[k] == hashlib.sha256(kept.encode()).hexdigest() or k == 61


def test_empty(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_rows_without_ids_and_repeated_rows(spark, tmp_path):
    """Decisions reach rows with null and repeated ids; other texts of the same id stay; extra columns don't matter."""
    rng = random.Random(22)
    item, near = odd.prose(rng, 30), odd.prose(rng, 300)
    own = [odd.prose(rng, 80) for _ in range(12)]
    leak = f"{odd.prose(rng, 50)} {item} {odd.prose(rng, 50)}"
    data = [(1, own[0]), (1, own[0]), (1, own[1]), (2, near), (2, near), (None, near), (3, near), (None, own[2]), (None, own[2]), (None, own[3]), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, None if i % 3 else "en", None if i % 2 else "s", None) for i, (k, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: corpus_pipeline.F.lit("clash") for c in (*corpus_pipeline.KEY, "group", "fp", "n", "best", "other_doc_id", "first", "bucket", "g", "own")})
    kept = stage("SimHash near-dedup")(spark, written(docs, "test"), "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, own[0]), (1, own[1]), (2, near), (0, own[2]), (0, own[3]), (4, "")])

    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, item)], "item_id long, text string").withColumn("key_a", corpus_pipeline.F.lit(0)).write.parquet(f"{sf}/benchmark.parquet")
    rows = [(None, leak), (None, own[4]), (7, leak), (7, own[5]), (7, own[5]), (8, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("key_a", corpus_pipeline.F.lit("clash"))
    left = stage("benchmark decontamination")(spark, written(docs, "test"), sf)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(0, own[4]), (7, own[5]), (7, own[5]), (8, "")])
    # the second row of the leak's text is cut whole, as a null id is smaller than any other
    assert stage("suffix-array dedup")(spark, written(docs, "test"), sf).count() == 5
    assert stage("BPE encoding")(spark, written(docs, "test"), sf).count() == 6


def test_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage("language ID")(spark, docs, "").count() == 0
