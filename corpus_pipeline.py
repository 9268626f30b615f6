"""A corpus pipeline over documents: each stage reads what the one before it wrote.

Decisions are taken back to rows by their key: doc_id, which may be null or
repeated, with 128 bits of the text's hashes. So a row without an id is decided
like any other, and of two texts with one id each has its own decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.bpe import bpe_tokens
from tabulon.llm.common import forget, spread_join, table, tables_made, written
from tabulon.llm.decontamination import contaminated
from tabulon.llm.language_id import held_out, learn, predict
from tabulon.llm.simhash import near_duplicates
from tabulon.llm.suffixes import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = ("key_a", "key_b")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("key_a"), F.xxhash64("text", F.lit(1)).alias("key_b"))


def beside(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of docs (keyed) whose key is in found (left_semi), or isn't (left_anti)."""
    other = found.select(*(F.col(c).alias(f"other_{c}") for c in ("doc_id", *KEY)))
    same: Column = F.col("doc_id").eqNullSafe(F.col("other_doc_id"))
    for c in KEY:
        same = same & (F.col(c) == F.col(f"other_{c}"))
    return docs.join(other, same, how)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the stage's input names; those without letters, or as near to two languages, go. Where the input names no language, none is known and all go."""
    docs = docs.select(*COLUMNS)
    learned = docs.where(~held_out("doc_id", 4, 2) & F.col("doc_id").isNotNull())
    found = predict(docs, learn(learned), carry=COLUMNS[1:])
    return found.where(~F.col("rejected")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that near-duplicate links connect, the one with the smallest doc_id; of equal ids, that with the smallest key; a row without an id only where none has one. Of rows that repeat id and text, one."""
    shaped = keyed(docs)
    found = written(near_duplicates(shaped, carry=KEY).select("doc_id", "group", *KEY), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *KEY)
    several = written(found.groupBy("group").agg(F.count("*").alias("n"), F.min(place).alias("best")).where("n > 1"), "groups-of-several")
    judged = written(spread_join(found, several, ["group"], "left").select("doc_id", *KEY, F.coalesce(place != F.col("best"), F.lit(False)).alias("lost"), F.col("n").isNotNull().alias("shared")), "judged")
    # most ids that go have no row that stays: ids alone make a small table, whose size is known before texts are joined, so they needn't be shuffled for few of them
    ids = judged.where("doc_id is not null").groupBy("doc_id").agg(F.min("lost").alias("lost")).where("lost").select("doc_id")
    ids = written(ids, "near-copies")
    others = written(judged.where("lost").join(ids, "doc_id", "left_anti").select("doc_id", *KEY).distinct(), "other-copies")
    again = written(judged.where("shared and not lost").groupBy("doc_id", *KEY).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    kept = beside(shaped.join(ids, "doc_id", "left_anti"), others, "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    # a text in a struct is compared last, after all that may differ between rows that repeat it
    one = beside(kept, again, "left_semi").groupBy("doc_id", *KEY).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("first"))
    return beside(kept, again, "left_anti").select(*COLUMNS).unionByName(one.select("doc_id", "first.*").select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go. A character that was cut in two is dropped."""
    found = remove_repeats(docs, with_text=True, carry=("lang", "source"))
    left = found.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    # invalid UTF-8 is what is left of a cut character: U+FFFD marks it, and no other text has been given new ones
    valid = F.expr("coalesce(try_validate_utf8(cast(kept as string)), replace(make_valid_utf8(cast(kept as string)), '�', ''))")
    return left.select("doc_id", valid.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    shaped = keyed(docs)
    found = written(contaminated(shaped, table(spark, sf_dir, "benchmark"), carry=KEY).select("doc_id", *KEY).distinct(), "leaks")
    return beside(shaped, found, "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding: decoded_sha256 is that of the text."""
    return bpe_tokens(docs, carry=("lang", "source"))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way goes when its result is written, and that when the next one has read it; empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with tables_made() as made:
            before, docs = docs, stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = written(docs, f"stage-{k + 1}")
                for t in made[:-1]:
                    forget(t)
                if k:
                    forget(before)
    return docs
