"""Readers of delimited, JSON, text and binary inputs, strict or tolerant as named."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .logs import lines


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """All columns as strings, by header; compressed files are read by their suffix. A row of another width fails."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A record a line, blank lines skipped; a line that is no record fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_tolerant(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """As json_lines, but lines that can't be read, and rows without a key, are left out: what a crash left behind."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & F.col(key).isNotNull()).drop("_bad")


def json_document(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """A document that is a list of records, or holds one under field (the first list of records if not named)."""
    d = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in d.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    field = field or (lists[0] if lists else None)
    return d.select(F.explode(field).alias("r")).select("r.*") if field else d


def merged_parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts that writers.parts made, as one table with each row's part and its position in the part's file: sorting by both gives the order of writing."""
    return spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("position"))


def mixed_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines that are records or lists of records, with their file and place in it (the line's number from 1, and the item's in its list from 0); others are left out."""
    found = lines(spark, path).select("value", "file", F.col("line").alias("place"))
    many = F.from_json("value", ArrayType(schema))
    one = F.array(F.from_json("value", schema))
    rows = F.when(F.ltrim("value").startswith("["), many).when(F.ltrim("value").startswith("{"), one)
    return found.select("file", "place", F.posexplode(rows).alias("item", "r")).select("file", "place", "item", "r.*")


def shards(spark: SparkSession, root: str, schema: StructType, key: str, name: str = "records.jsonl") -> DataFrame:
    """All files of that name under root as one table; keys that occur twice fail."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    twice = rows.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {[r[key] for r in twice]}")
    return rows


def latest_epoch(spark: SparkSession, root: str, pattern: str = r"epoch[_-]?(\d+)") -> int | None:
    """The largest number in the names of the files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(F.max(F.regexp_extract("path", pattern, 1).try_cast("int")).alias("e")).first().e


def response_contents(spark: SparkSession, path: str) -> DataFrame:
    """custom_id and the first choice's message of API responses, a JSON object a line; incomplete ones are left out."""
    lines = spark.read.text(path)
    got = lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.response.body.choices[0].message.content").alias("content"))
    return got.where("custom_id is not null and length(trim(content)) > 0")


def markdown_table(spark: SparkSession, path: str, cells: int, header: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a Markdown table with that many cells, as an array, without the header and its rule."""
    rows = spark.read.text(path).where(F.ltrim("value").startswith("|"))
    row = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    found = rows.select(row.alias("cells")).where((F.size("cells") == cells) & ~F.get("cells", 0).rlike("^:?-+:?$"))
    return found.where(F.col("cells") != F.array(*map(F.lit, header))) if header else found


def files(spark: SparkSession, root: str, without: tuple[str, ...] = ()) -> DataFrame:
    """path, length, modificationTime and SHA-256 of each file under root, but for those in the named folders."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    for name in without:
        f = f.where(~F.col("path").contains(f"/{name}/"))
    return f.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def with_asset(rows: DataFrame, name: str, assets: DataFrame) -> DataFrame:
    """Rows whose file stands among assets (path), by its name."""
    have = assets.select(F.element_at(F.split("path", "/"), -1).alias("_file")).distinct()
    return rows.join(have, F.element_at(F.split(name, "/"), -1) == F.col("_file"), "left_semi")


def config(path: str, load=None) -> dict:
    """A JSON or YAML mapping; `_base` names a file whose values it overrides, and so on."""
    import json

    with open(path, encoding="utf-8") as f:
        own = load(f) if load else json.load(f)
    base = own.pop("_base", None)
    return merged(config(str(PurePosixPath(path).parent / base), load), own) if base else own


def merged(under: dict, over: dict) -> dict:
    return under | {k: merged(under[k], v) if isinstance(v, dict) and isinstance(under.get(k), dict) else v for k, v in over.items()}
