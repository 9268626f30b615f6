"""Run folders with a manifest of what made them, and quarantine of what a crash cut off."""

from __future__ import annotations

import hashlib
import json
import os
import platform
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .logs import lines
from .writers import atomic


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def start(root: str, config: dict, spark: SparkSession) -> str:
    """A new folder with run.json: time, configuration, its hash, versions."""
    now = datetime.now(UTC)
    path = os.path.join(root, f"{now:%Y%m%dT%H%M%S%f}-{config_hash(config)[:8]}")
    os.makedirs(path)
    atomic(os.path.join(path, "run.json"), json.dumps({"started": now.isoformat(), "config": config, "config_sha256": config_hash(config), "spark": spark.version, "python": platform.python_version()}, indent=2, sort_keys=True) + "\n")
    return path


def torn(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined: file, line, byte_offset, value) of an append log. A line is torn if it is its file's last, has no line end and is no record; any other line that is none fails."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    read = lines(spark, path).where("trim(value) <> ''").withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull()
    records = read.where(~bad | F.col("ended"))
    place = F.concat(F.lit("a line that isn't torn off is no record: "), F.col("file"), F.lit(", line "), F.col("line").cast("string"))
    ok = records.withColumn("r", F.when(bad, F.raise_error(place)).otherwise(F.col("r")))
    return ok.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields]), read.where(bad & ~F.col("ended")).select("file", "line", "byte_offset", "value")
