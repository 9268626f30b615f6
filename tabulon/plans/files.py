"""Registered queries on files: each writes a given table whole, in the format it is about, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import audits, integrity, scorers
from ..sources import readers, writers
from ..sources.scratch import folder
from .carriers import predictions, table
from .queries import query


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


@query("SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, cast(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def tsv_scan(spark, sf_dir):
    """Tab-separated with a header, in order; read as strings."""
    columns = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
    writers.delimited(table(spark, sf_dir, "customer").select(*columns), path := folder(spark, "tsv"), ["c_custkey"])
    return readers.delimited(spark, path, columns)


@query("SELECT cast(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def tsv_gzip_scan(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    writers.delimited(table(spark, sf_dir, "orders").select(*columns), path := folder(spark, "tsv-gz"), ["o_orderkey"], compression="gzip")
    return readers.delimited(spark, path, columns)


@query("SELECT cast(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, cast(p_size AS VARCHAR) AS p_size FROM part")
def csv_scan(spark, sf_dir):
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    writers.delimited(table(spark, sf_dir, "part").select(*columns), path := folder(spark, "csv"), ["p_partkey"], sep=",")
    return readers.delimited(spark, path, columns, sep=",")


@query("SELECT doc_id, text, lang, source FROM documents")
def jsonl_scan(spark, sf_dir):
    """Whole texts through JSON lines: quotes, line ends and nulls come back as they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    writers.json_lines(docs, path := folder(spark, "jsonl"))
    return readers.json_lines(spark, path, docs.schema)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def jsonl_torn_scan(spark, sf_dir):
    """Every seventh line is cut as a crash would, every fifth lacks its key: both are left out."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("event_id"), "user_id", "event_type"), {"ignoreNullFields": "false"})
    e.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path := folder(spark, "torn"))
    return readers.json_lines_tolerant(spark, path, e.schema, "event_id")


@query("SELECT o_orderkey AS record_id, o_orderkey % 6 AS shard, o_orderstatus FROM orders")
def shard_scan(spark, sf_dir):
    """Shards in folders of their own as one table, its key unique."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 6).alias("shard"), "o_orderstatus")
    o.withColumn("folder", F.col("shard")).write.partitionBy("folder").json(path := folder(spark, "shards"))
    return readers.shards(spark, path, o.schema, "record_id", "*.json")


@query("SELECT o_orderkey AS record_id, o_orderstatus, o_orderkey // 2000 AS part, row_number() OVER (PARTITION BY o_orderkey // 2000 ORDER BY o_orderkey) - 1 AS position FROM orders")
def merged_parts_scan(spark, sf_dir):
    """Parts of 2,000 keys each, merged again by part and position."""
    writers.parts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus"), path := folder(spark, "parts"), "record_id", 2000)
    merged = readers.merged_parts(spark, path)
    return merged.select("record_id", "o_orderstatus", F.col("part").cast("long").alias("part"), F.col("position").cast("long").alias("position"))


@query("""SELECT o_orderkey AS key, o_orderstatus AS status, 0 AS item FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT -o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderkey % 3 = 1""")
def mixed_json_scan(spark, sf_dir):
    """Lines that are a record, a list of two, or neither."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    one = lambda key: F.struct(key.alias("key"), F.col("o_orderstatus").alias("status"))
    key = F.col("o_orderkey")
    line = F.when(key % 3 == 0, F.to_json(one(key))).when(key % 3 == 1, F.to_json(F.array(one(key), one(-key)))).otherwise(F.concat(F.lit("# "), key.cast("string")))
    o.select(line.alias("value")).write.text(path := folder(spark, "mixed"))
    return readers.mixed_json(spark, path, _schema("key long, status string")).select("key", "status", "item")


@query("SELECT max(month(o_orderdate)) AS epoch FROM orders")
def latest_epoch_scan(spark, sf_dir):
    """The latest of the epochs that files are named after, here months of orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("epoch_"), F.month("o_orderdate")).alias("run"))
    o.write.partitionBy("run").json(path := folder(spark, "epochs"))
    return spark.range(1).select(F.lit(readers.latest_epoch(spark, path)).cast("long").alias("epoch"))


@query("SELECT 'task-' || conv_id || '-' || turn AS custom_id, text AS content FROM conversations WHERE length(trim(text)) > 0")
def response_scan(spark, sf_dir):
    """Turns as responses of an API, an object a line; those without content are left out."""
    c = table(spark, sf_dir, "conversations")
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")
    name = F.concat(F.lit("task-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id")
    c.select(F.to_json(F.struct(name, body)).alias("value")).write.text(path := folder(spark, "responses"))
    return readers.response_contents(spark, path)


@query("SELECT cast(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 11 <> 0")
def markdown_table_scan(spark, sf_dir):
    """Rows of a Markdown table; those of another width, headers and rules are left out."""
    o = table(spark, sf_dir, "orders")
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    row = F.when(F.col("o_orderkey") % 11 == 0, cells(F.col("o_orderkey").cast("string"))).otherwise(cells(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")))
    head = spark.createDataFrame([("| key | status | priority |",), ("|---|---|---|",), ("some text",)], "value string")
    head.union(o.select(row.alias("value"))).write.text(path := folder(spark, "markdown"))
    found = readers.markdown_table(spark, path, 3, ("key", "status", "priority"))
    return found.select(*[F.col("cells")[k].alias(c) for k, c in enumerate(("key", "status", "priority"))])


@query("SELECT o_orderpriority AS folder, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def file_listing(spark, sf_dir):
    """Files of a tree but for those below a folder that is left out, each with its SHA-256; here joined to what they hold."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("folder"), "o_orderkey")
    o.withColumn("kept", F.col("folder")).write.partitionBy("o_orderstatus", "folder").json(path := folder(spark, "tree"))
    end = lambda c: F.array_join(F.slice(F.split(c, "/"), -3, 3), "/")
    listed = readers.files(spark, path, without=("o_orderstatus=F",)).where(F.length("sha256") == 64).select(end(F.col("path")).alias("file"))
    rows = spark.read.schema("kept string").option("recursiveFileLookup", True).json(path).select("kept", end(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("file"))
    return rows.join(listed, "file", "left_semi").groupBy(F.col("kept").alias("folder")).agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE string_split(url, '/')[-1] IN (SELECT string_split(url, '/')[-1] FROM pages WHERE page_id % 2 = 0)")
def asset_presence(spark, sf_dir):
    """Pages whose file name stands among the assets, here the even pages' ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return readers.with_asset(pages, "url", pages.where("page_id % 2 = 0").select(F.col("url").alias("path"))).select("page_id")


@query("SELECT conv_id, turn, length(text) AS score FROM conversations WHERE text IS NOT NULL")
def batch_scan(spark, sf_dir):
    """Rows in batches of fixed size through a plug-in, here one that gives lengths; equal pairs are scored once."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("left"), F.lit("").alias("right"))
    found = scorers.scored(c, lambda: lambda left, right: [float(len(x)) for x in left], batch=16)
    return found.select("conv_id", "turn", F.col("score").cast("long").alias("score"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey")
def matrix_scan(spark, sf_dir):
    """A matrix of counts, a line for each customer, without a header."""
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    writers.matrix(wide, path := folder(spark, "matrix"), "o_custkey")
    return spark.read.schema("f long, o long, p long").csv(path)


@query("SELECT count(*) AS n, 0 AS only_tsv, 0 AS only_csv FROM customer")
def tsv_equals_csv(spark, sf_dir):
    """One table written as TSV and as CSV: what each has that the other hasn't, row by row with repeats."""
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    rows = table(spark, sf_dir, "customer").select(*columns)
    writers.delimited(rows, tsv := folder(spark, "tsv"), ["c_custkey"])
    writers.delimited(rows, csv := folder(spark, "csv"), ["c_custkey"], sep=",")
    a, b = readers.delimited(spark, tsv, columns), readers.delimited(spark, csv, columns, sep=",")
    return audits.both_ways(a, b, "only_tsv", "only_csv")


@query("SELECT arm, true AS identical FROM (VALUES ('plain'), ('point'), ('plain_desc'), ('point_desc')) v(arm)")
def deterministic_rerun(spark, sf_dir):
    """Predictions hashed, written, read and hashed again: both digests are equal."""
    p = predictions(spark, sf_dir).where("condition = 'source'").select("arm", "record_id", "dataset_index", "pred")
    p.write.parquet(path := folder(spark, "rerun"))
    hashed = lambda df, name: integrity.ordered_hash(df, ["arm"], "pred", "dataset_index").select("arm", F.col("digest").alias(name))
    return hashed(p, "x").join(hashed(spark.read.parquet(path), "y"), "arm").select("arm", (F.col("x") == F.col("y")).alias("identical"))
