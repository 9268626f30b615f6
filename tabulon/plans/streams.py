"""Registered queries on streams, caches and random maps: each takes a given table whole through state, files or joins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.prompt_cache import PromptCache
from ..sources.scratch import folder
from ..streaming import frozen_store, monitor
from .carriers import table
from .queries import query

_ORDER_HASH = "sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority)"


@query(f"""WITH m AS (SELECT o_orderkey AS k, {_ORDER_HASH} AS h FROM orders), r AS (SELECT k, 1 AS attempt, CASE WHEN k % 11 = 3 THEN 'row_hash_mismatch' WHEN k % 13 = 5 THEN 'record_hash_mismatch' WHEN k % 7 = 2 THEN 'not_successful' ELSE 'accepted' END AS v FROM m),
again AS (SELECT m.k, 2 AS attempt, CASE WHEN r.v = 'accepted' THEN 'duplicate_key' ELSE 'accepted' END AS v FROM m JOIN r ON r.k = m.k WHERE m.k % 7 = 2 OR m.k % 5 = 1)
SELECT cast(k AS VARCHAR) AS primary_key, cast(attempt AS BIGINT) AS attempt, v AS verdict FROM r UNION ALL SELECT cast(k AS VARCHAR), attempt, v FROM again UNION ALL SELECT 'c' || c_custkey, 1, 'foreign_key' FROM customer""")
def frozen_store_verdicts(spark, sf_dir):
    """All orders as records of a log, in two runs: faults of every kind, keys of no order, then second attempts; state remembers the first run."""
    o = table(spark, sf_dir, "orders")
    hashed = o.select(F.col("o_orderkey").alias("k"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("row_hash"), "o_orderpriority")
    manifest = hashed.select(F.col("k").cast("string").alias("primary_key"), "row_hash")
    root, log = folder(spark, "store"), folder(spark, "store-log")
    k = F.col("k")

    def record(df: DataFrame, attempt: int, faults: bool) -> DataFrame:
        bad = F.lit(faults)
        return df.select(k.cast("string").alias("primary_key"), F.when(bad & (k % 11 == 3), F.lit("another")).otherwise(F.col("row_hash")).alias("row_hash"), F.when(bad & (k % 7 == 2), "error").otherwise("success").alias("status"), F.lit(attempt).cast("long").alias("attempt"), F.col("o_orderpriority").alias("payload"), k.alias("k"))

    def logged(records: DataFrame, tamper: bool) -> None:
        whole = frozen_store.with_hash(records.drop("k")) if not tamper else frozen_store.with_hash(records).withColumn("payload", F.when((F.col("attempt") == 1) & ~F.col("primary_key").startswith("c") & (F.col("primary_key").try_cast("long") % 13 == 5), F.lit("changed")).otherwise(F.col("payload")))
        whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).write.mode("append").text(log)

    foreign = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("primary_key"), F.lit("none").alias("row_hash"), F.lit("success").alias("status"), F.lit(1).cast("long").alias("attempt"), F.lit("x").alias("payload"), F.lit(None).cast("long").alias("k"))
    logged(record(hashed, 1, True).unionByName(foreign), True)
    frozen_store.ingest(spark, log, root, {"run": "orders"}, manifest)
    logged(record(hashed.where((k % 7 == 2) | (k % 5 == 1)), 2, False), False)
    return frozen_store.ingest(spark, log, root, {"run": "orders"}, manifest).select("primary_key", "attempt", "verdict")


@query("""WITH e AS (SELECT cast(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS batch_id, ts, event_type, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), f AS (SELECT batch_id, min(ts) + INTERVAL 6 HOUR AS deadline FROM e GROUP BY batch_id),
t AS (SELECT batch_id, min({'ts': ts, 's': CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END, 'o': CASE WHEN event_type = 'purchase' AND event_id % 4 <> 1 THEN 'file-' || event_id ELSE '' END}) AS x FROM e WHERE event_type IN ('purchase', 'error') GROUP BY batch_id)
SELECT f.batch_id, CASE WHEN x IS NULL OR x.ts > deadline THEN 'timed_out' WHEN x.s = 'completed' AND x.o = '' THEN 'completed_without_output' ELSE x.s END AS outcome, CASE WHEN x IS NULL OR x.ts > deadline THEN deadline ELSE x.ts END AS ended_at, CASE WHEN x.ts <= deadline AND x.o <> '' THEN x.o END AS output
FROM f LEFT JOIN t ON t.batch_id = f.batch_id WHERE x.ts <= deadline OR deadline <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)""")
def batch_outcomes(spark, sf_dir):
    """A user's events of a day as polls of a batch: purchases complete it, errors fail it, and after six hours it has timed out."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("in_progress")
    output = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 != 1), F.concat(F.lit("file-"), F.col("event_id").cast("string")))
    polls = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"), F.col("ts").cast("timestamp").alias("polled_at"), state.alias("state"), output.alias("output")).where("user_id is not null and ts is not null")
    source, out, checkpoint = (folder(spark, f"polls-{n}") for n in ("in", "out", "state"))
    polls.write.parquet(source)
    with frozen_store.state_kept(spark):
        stream = spark.readStream.schema(polls.schema).parquet(source)
        monitor.outcomes(stream, timedelta(hours=6), "1 hour").withColumn("ended_at", F.col("ended_at").cast("timestamp_ntz")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("batch_id string, outcome string, ended_at timestamp_ntz, output string").parquet(out)


def stand_in(prompts: DataFrame) -> DataFrame:
    """Answers from a hash in place of a model's: one of four choices, or none that can be read."""
    h = F.conv(F.substring("prompt_hash", 1, 4), 16, 10).cast("int")
    return prompts.select("prompt_hash", F.when(h % 5 != 0, h % 4).cast("int").alias("prediction"), F.substring("prompt_hash", 1, 6).alias("raw"))


_ANSWERED = "CASE WHEN {0} % 5 <> 0 THEN cast({0} % 4 AS INT) END"


def _answer(prompt: str) -> str:
    return _ANSWERED.format(f"cast('0x' || substr(sha256({prompt}), 1, 4) AS INT)")


@query(f"""WITH a AS (SELECT o_orderkey, 'Priority ' || o_orderpriority || ', status ' || o_orderstatus AS base, CASE WHEN o_orderkey % 6 <> 0 THEN 'Customer ' || o_custkey || ', priority ' || o_orderpriority END AS own, cast(o_orderkey % 4 AS INT) AS target FROM orders),
s AS (SELECT *, {_answer("base")} AS b, {_answer("own")} AS r FROM a)
SELECT o_orderkey, b AS baseline_prediction, b IS NULL AS baseline_failed, CASE WHEN own IS NOT NULL THEN r END AS rationale_prediction, CASE WHEN own IS NOT NULL THEN r IS NULL END AS rationale_failed, coalesce(b = target, false) AS baseline_correct, coalesce(own IS NOT NULL AND r = target, false) AS rationale_correct FROM s""")
def prompt_cache_scores(spark, sf_dir):
    """Each order's two prompts, asked in two jobs of which the second finds half of them answered; few baseline prompts serve all orders."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit("Priority "), "o_orderpriority", F.lit(", status "), "o_orderstatus").alias("base"), F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(", priority "), "o_orderpriority")).alias("own"), (F.col("o_orderkey") % 4).cast("int").alias("target"))
    cache = PromptCache(spark, folder(spark, "prompt-cache"), "stand-in", "1", max_length=64)
    prompts = rows.select(F.explode(F.array("base", "own")).alias("prompt"), "o_orderkey")
    cache.ask(prompts.where("o_orderkey % 2 = 0"), stand_in)
    cache.ask(prompts, stand_in)
    met = cache.looked_up(rows, "o_orderkey", {"baseline": "base", "rationale": "own"})
    right = lambda c: F.coalesce(F.col(f"{c}_prediction") == F.col("target"), F.lit(False)).alias(f"{c}_correct")
    return met.select("o_orderkey", "baseline_prediction", "baseline_failed", "rationale_prediction", "rationale_failed", right("baseline"), right("rationale"))


@query("""WITH f AS (SELECT 'frame ' || n_regionkey || '/' || c_mktsegment AS frame, count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT 'arm_' || arm AS arm, frame, n AS sources, n AS targets, keys AS distinct_targets, 0 AS met_itself, n AS changed FROM f, (VALUES (0), (1), (2)) a(arm)""")
def random_derangement_audit(spark, sf_dir):
    """Customers mapped at random to customers of another region and segment, for three arms: by frame, what comes and goes."""
    nations = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"))  # one row a nation
    c = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select("c_custkey", F.concat(F.lit("frame "), F.col("n_regionkey").cast("string"), F.lit("/"), "c_mktsegment").alias("frame"))
    out = None
    for arm in range(3):
        pairs = sampling.random_derangement(c, "c_custkey", "frame", 20240 + arm)
        sides = F.array(F.struct(F.col("source_frame").alias("frame"), F.lit(1).alias("s"), F.lit(0).alias("t"), F.lit(None).cast("long").alias("k"), (F.col("source_frame") == F.col("target_frame")).cast("int").alias("same")), F.struct(F.col("target_frame").alias("frame"), F.lit(0).alias("s"), F.lit(1).alias("t"), F.col("target").alias("k"), F.lit(0).alias("same")))
        each = pairs.select(F.explode(sides).alias("x")).select("x.*")
        audit = each.groupBy("frame").agg(F.sum("s").alias("sources"), F.sum("t").alias("targets"), F.countDistinct("k").alias("distinct_targets"), F.sum("same").cast("int").alias("met_itself"))
        audit = audit.select(F.lit(f"arm_{arm}").alias("arm"), "*", (F.col("sources") - F.col("met_itself")).alias("changed"))
        out = audit if out is None else out.unionByName(audit)
    return out
