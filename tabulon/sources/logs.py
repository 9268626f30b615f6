"""Lines of log files with their places: number, byte offset, and if a line end closes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), byte_offset (from 0), value, ended: every line of the text files at path.

    A file is read in splits; within one, rows come in the order of the file,
    so places are counted split by split and moved by the splits before, of
    which there is one row each. Only \\n ends a line. A file's last line is
    ended if its lines, each with an end, make up the file's size; a byte-order
    mark at its start is the engine's to skip, and counts as part of it."""
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_block_start", "split"), ("file_size", "size"))]
    read = spark.read.option("lineSep", "\n").text(path).select("value", *meta, F.monotonically_increasing_id().alias("_id"))
    long = F.octet_length("value").cast("long") + 1
    own = Window.partitionBy("file", "split").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = read.select("*", F.count("*").over(own).alias("_line"), F.sum(long).over(own).alias("_upto"), long.alias("_bytes"))
    parts = read.groupBy("file", "split", "size").agg(F.count("*").alias("n"), F.sum(long).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("file")
    moved = parts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_lines"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_before"), F.sum("n").over(all_).alias("_all"), F.sum("bytes").over(all_).alias("_total"))
    found = placed.join(moved, ["file", "split"])
    line = F.col("_lines") + F.col("_line")
    # without a last line end the lines, each counted with one, are a byte longer than the file; a mark is three bytes that no line has
    cut = (line == F.col("_all")) & ((F.col("_total") - F.col("size")).isin(1, -2))
    return found.select("file", line.alias("line"), (F.col("_before") + F.col("_upto") - F.col("_bytes")).alias("byte_offset"), "value", (~cut).alias("ended"))
