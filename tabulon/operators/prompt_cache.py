"""Answers to prompts, kept by model and revision: what is known isn't asked again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import set_digest
from ..sources.scratch import written
from .joins import spread_join
from .store import StoreViolation

#: What a model was asked, what it answered (null: it couldn't be read), and its words.
ANSWER = "prompt_hash string, prediction int, raw string"


class PromptCache:
    """A folder for each (model, revision) under root, with the settings that its answers were made under.

    Each job writes a folder of its own, named by a digest of the prompts that
    it asks. A job that runs twice replaces what it wrote, so nothing doubles;
    two jobs that ask the same prompt at once leave it twice, and reading keeps
    one. Answers that differ for a prompt are a violation."""

    def __init__(self, spark: SparkSession, root: str, model: str, revision: str, **settings: str | int | float | bool):
        self.spark = spark
        self.metadata = {"model": model, "revision": revision, **settings}
        version = hashlib.sha256(json.dumps([model, revision]).encode()).hexdigest()[:16]
        self.path = f"{root.rstrip('/')}/{version}"
        self._check()

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _check(self) -> None:
        """Settings are written once; other ones for the same model and revision raise."""
        where, fs = self._file("_settings.json")
        if not fs.exists(where):
            out = fs.create(where, False)
            try:
                out.write(bytearray(json.dumps(self.metadata, sort_keys=True).encode()))
            finally:
                out.close()
            return
        # names that begin with an underscore are hidden from the reader of folders, not from one of files
        data = fs.open(where)
        try:
            there = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()
        for k in sorted(there.keys() | self.metadata.keys()):
            if there.get(k) != self.metadata.get(k):
                raise StoreViolation(f"answers were made with {k} = {there.get(k)!r}, not {self.metadata.get(k)!r}")

    def answers(self) -> DataFrame:
        """prompt_hash, prediction, raw: one row a prompt. A prompt with answers that differ fails the job that reads it."""
        where, fs = self._file("answers")
        if not fs.exists(where):
            return self.spark.createDataFrame([], ANSWER)
        read = self.spark.read.schema(ANSWER).option("recursiveFileLookup", True).parquet(f"{self.path}/answers")
        answer = F.struct("prediction", "raw")
        one = read.groupBy("prompt_hash").agg(F.min(answer).alias("a"), F.max(answer).alias("z"))
        differ = F.raise_error(F.concat(F.lit("answers differ for prompt "), F.col("prompt_hash")))
        return one.select("prompt_hash", F.when(F.col("a").eqNullSafe(F.col("z")), F.col("a")).otherwise(differ).alias("a")).select("prompt_hash", "a.*")

    def ask(self, prompts: DataFrame, score: Callable[[DataFrame], DataFrame]) -> int:
        """Scores the prompts (prompt) that have no answer yet, each once, and returns how many. score: prompt_hash, prompt to ANSWER."""
        tasks = prompts.where("prompt is not null").select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").groupBy("prompt_hash").agg(F.min("prompt").alias("prompt"))
        new = tasks.join(self.answers().select("prompt_hash"), "prompt_hash", "left_anti")
        job = new.agg(F.count("*").alias("n"), set_digest(F.col("prompt_hash")).alias("digest")).first()
        if job.n:
            score(new).select(*[c.split()[0] for c in ANSWER.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/answers/{job.digest[:32]}")
        return job.n

    def looked_up(self, rows: DataFrame, key: str, prompts: dict[str, str]) -> DataFrame:
        """rows with, for each (name: column of prompts), name_prediction, name_failed: answered but unreadable, or never asked.

        All of a row's prompts are looked up in one read of the answers: rows are
        their keys and prompt hashes, a row for each prompt, and come back by key,
        which must be unique. A null prompt was not to be asked: both are null."""
        slots = F.array(*[F.struct(F.lit(name).alias("slot"), F.sha2(column, 256).alias("prompt_hash")) for name, column in prompts.items()])
        asked = rows.select(F.col(key).alias("_key"), F.explode(slots).alias("s")).select("_key", "s.*").where("prompt_hash is not null")
        met = spread_join(written(asked, "asked"), self.answers().select("prompt_hash", "prediction"), ["prompt_hash"], "left")
        of = lambda name, value: F.max(F.when(F.col("slot") == name, value))
        wide = met.groupBy("_key").agg(*[c for name in prompts for c in (of(name, F.col("prediction")).alias(f"{name}_prediction"), of(name, F.col("prediction").isNull()).alias(f"{name}_failed"))])
        return rows.join(wide, F.col(key) == F.col("_key"), "left").drop("_key")
