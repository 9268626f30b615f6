"""Registered queries of audits, formats and reports over the evaluation-shaped views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import audits, classification, integrity
from .carriers import PREDICTIONS_SQL, TAGGED_SQL, predictions, records, table, tagged
from .queries import query

P = PREDICTIONS_SQL
CLASSES = f"""{P}, k(cls) AS (VALUES (0), (1), (2), (3)), c AS (SELECT cls, count(*) FILTER (pred = cls) AS p, count(*) FILTER (gold = cls) AS s, count(*) FILTER (pred = cls AND gold = cls) AS h FROM predictions CROSS JOIN k GROUP BY cls),
r AS (SELECT *, h / (p + 1e-12) AS pr, h / (s + 1e-12) AS re FROM c), f AS (SELECT *, 2 * pr * re / (pr + re + 1e-12) AS f1 FROM r), t AS (SELECT avg(pr) AS mp, avg(re) AS mr, avg(f1) AS mf, sum(h) AS h, sum(p) AS p, sum(s) AS s FROM f),
u AS (SELECT *, h / (p + 1e-12) AS up, h / (s + 1e-12) AS ur FROM t)"""


@query(f"""{CLASSES} SELECT round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, round(up, 9) AS micro_precision, round(ur, 9) AS micro_recall, round(2 * up * ur / (up + ur + 1e-12), 9) AS micro_f1, round(h / s, 9) AS accuracy FROM u""")
def classification_overall(spark, sf_dir):
    return classification.overall(predictions(spark, sf_dir))


@query(f"""{P}, b AS (SELECT least(cast(ceil(confidence / 2 * 10) AS INT), 10) - 1 AS bin, correct, confidence / 2 AS c FROM predictions), g AS (SELECT bin, count(*) AS n, avg(correct) AS acc, avg(c) AS conf FROM b GROUP BY bin)
SELECT cast(r.k AS INT) AS bin, coalesce(n, 0) AS n, round(acc, 9) AS accuracy, round(conf, 9) AS mean_confidence, coalesce(round(abs(acc - conf) * n / (SELECT count(*) FROM b), 9), 0) AS error_share FROM range(10) r(k) LEFT JOIN g ON g.bin = r.k""")
def calibration_all_bins(spark, sf_dir):
    """Confidences halved, so that the upper bins are empty."""
    return classification.calibration_table(predictions(spark, sf_dir).withColumn("confidence", F.col("confidence") / 2))


@query(f"""{P}, b AS (SELECT pred, least(cast(ceil(confidence * 10) AS INT), 10) - 1 AS bin, correct, confidence AS c FROM predictions), g AS (SELECT pred, bin, count(*) AS n, avg(correct) AS acc, avg(c) AS conf FROM b GROUP BY ALL),
t AS (SELECT pred, sum(n) AS t FROM g GROUP BY pred), e AS (SELECT g.pred, round(sum(round(abs(acc - conf) * n / t, 9)), 6) AS ece, cast(sum(n) AS BIGINT) AS n FROM g JOIN t USING (pred) GROUP BY g.pred)
SELECT cast(r.k AS INT) AS pred, ece, coalesce(n, 0) AS n FROM range(6) r(k) LEFT JOIN e ON e.pred = r.k""")
def ece_all_classes(spark, sf_dir):
    """Six classes, two of which no row has."""
    return classification.expected_error_of_classes(predictions(spark, sf_dir), 6)


TRIPLE = f"""{P}, t AS (SELECT s.arm, s.correct AS s, g.correct AS g, a.correct AS a FROM predictions s JOIN predictions g ON g.arm = s.arm AND g.record_id = s.record_id AND g.condition = 'grey' JOIN predictions a ON a.arm = s.arm AND a.record_id = s.record_id AND a.condition = 'mismatch' WHERE s.condition = 'source')"""


@query(f"{TRIPLE} SELECT arm, s AS source_correct, g AS grey_correct, a AS alternate_correct, count(*) AS n FROM t GROUP BY ALL")
def known_change_triple(spark, sf_dir):
    """Source, grey and alternate of a record side by side, from one shuffle of the three; records that lack one are left out."""
    p = predictions(spark, sf_dir, conditions=("source", "grey", "mismatch"))
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("correct")))
    wide = p.groupBy("arm", "record_id").agg(of("source").alias("source_correct"), of("grey").alias("grey_correct"), of("mismatch").alias("alternate_correct")).na.drop()
    return wide.groupBy("arm", "source_correct", "grey_correct", "alternate_correct").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT o_orderkey AS k FROM orders), f AS (SELECT 'shard' AS found FROM m WHERE k % 101 = 0 UNION ALL SELECT 'output' FROM m WHERE k % 103 = 0 UNION ALL SELECT 'output.gold' FROM m WHERE k % 97 = 0 AND k % 103 <> 0
UNION ALL SELECT 'output.stratum' FROM m WHERE k % 89 = 0 AND k % 103 <> 0 UNION ALL SELECT 'dataset.frame_id' FROM m WHERE k % 83 = 0) SELECT found, count(*) AS n FROM f GROUP BY found""")
def field_audit(spark, sf_dir):
    """A manifest beside its shards, outputs and dataset, each with faults of its own."""
    m = records(spark, sf_dir).select("record_id", "gold", "frame_id", "stratum")
    k = F.col("record_id")
    shard = m.where(k % 101 != 0).select("record_id")
    output = m.where(k % 103 != 0).select("record_id", F.when(k % 97 == 0, F.col("gold") + 1).otherwise(F.col("gold")).alias("gold"), F.when(k % 89 != 0, F.col("stratum")).alias("stratum"))
    data = m.select("record_id", F.when(k % 83 == 0, -F.col("frame_id") - 1).otherwise(F.col("frame_id")).alias("frame_id"))
    found = audits.field_mismatches([("manifest", m), ("shard", shard), ("output", output), ("dataset", data)], "record_id", {"shard": [], "output": ["gold", "stratum"], "dataset": ["frame_id"]})
    return found.select(F.explode("found").alias("found")).groupBy("found").agg(F.count("*").alias("n"))


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'unlisted' WHEN page_id % 5 = 0 THEN 'differs' ELSE 'match' END AS status FROM pages")
def ledger_lookup(spark, sf_dir):
    """Pages beside a ledger of digests that lacks some and has others wrong. A url may have several pages, so pages are listed by their ids."""
    files = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("sha"))
    ledger = files.where("coalesce(page_id % 3 <> 0, true)").select("page_id", F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(F.col("sha")).alias("sha"))
    return audits.ledger_status(files, ledger, "page_id", "sha").select("url", "status")


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'invalid' ELSE 'valid' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def record_hash_audit(spark, sf_dir):
    """Rows with a hash of themselves, some of them changed since, some without."""
    o = hashing.with_record_hash(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    k = F.col("o_orderkey")
    changed = o.withColumns({"o_custkey": F.when(k % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "record_sha256": F.when(k % 7 != 0, F.col("record_sha256"))})
    return changed.groupBy(hashing.record_hash_status(changed).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT unnest(['rows', 'records', 'cells']) AS check, unnest([n * 24, n, 24]) AS expected, unnest([n * 24, n, 24]) AS actual, true AS holds FROM (SELECT count(*) AS n FROM orders)""")
def expected_counts(spark, sf_dir):
    p = predictions(spark, sf_dir)
    per = p.groupBy("arm", "condition").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("k"))
    counts = per.agg(F.sum("n").alias("rows"), F.max("k").alias("records"), F.count("*").alias("cells"), F.min("k").alias("least"))
    return audits.expected_counts(counts, {"rows": F.col("least") * 24, "records": F.col("least"), "cells": F.lit(24)})


@query("SELECT 'gold' AS column_name, 4 AS arms, 1 AS digests, true AS equal FROM orders LIMIT 1")
def cross_arm_equality(spark, sf_dir):
    """One digest for all arms' gold labels in order, or they differ."""
    h = integrity.ordered_hash(predictions(spark, sf_dir).where("condition = 'source'"), ["arm"], "gold", "dataset_index")
    return h.agg(F.lit("gold").alias("column_name"), F.count("*").cast("int").alias("arms"), F.countDistinct("digest").cast("int").alias("digests"), (F.countDistinct("digest") == 1).alias("equal"))


@query(f"{P} SELECT arm, condition, min(dataset_index) AS dataset_index, arg_min(record_id, dataset_index) AS record_id FROM predictions WHERE correct = 0 AND confidence >= 0.5 GROUP BY ALL")
def first_eligible_record(spark, sf_dir):
    return audits.first_eligible(predictions(spark, sf_dir), ["arm", "condition"], (F.col("correct") == 0) & (F.col("confidence") >= 0.5), "dataset_index", "record_id")


@query("SELECT o_custkey AS frame_id, min(o_orderkey) AS first, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place FROM orders GROUP BY o_custkey")
def appearance_order(spark, sf_dir):
    return audits.appearance(records(spark, sf_dir), "frame_id", "dataset_index")


@query("SELECT 'lang' AS filter, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'split', count(*) FROM documents")
def filter_if_present(spark, sf_dir):
    """A filter on a column that the table has, and on one that it hasn't."""
    d = table(spark, sf_dir, "documents")
    one = lambda c: audits.where_if_present(d, c, "en").agg(F.lit(c).alias("filter"), F.count("*").alias("n"))
    return one("lang").unionByName(one("split"))


@query(f"{P} SELECT arm, record_id, CASE WHEN starts_with(arm, 'plain') THEN 'frame-' || frame_id ELSE 'record-' || record_id END AS asset FROM predictions WHERE condition = 'source'")
def arm_assets(spark, sf_dir):
    """Which column names an asset depends on the arm."""
    p = predictions(spark, sf_dir).where("condition = 'source'")
    plain, point = F.concat(F.lit("frame-"), F.col("frame_id").cast("string")), F.concat(F.lit("record-"), F.col("record_id").cast("string"))
    return p.select("arm", "record_id", F.when(F.col("arm").startswith("plain"), plain).otherwise(point).alias("asset"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {str(c != 'text').lower()} AS allowed, count({c}) AS n FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def column_policy(spark, sf_dir):
    return audits.column_policy(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "lang", "source", "n_chars"])


_TOKENS = [("license", "required"), (". ", "required"), ("TODO", "forbidden"), ("<html", "forbidden")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS token, '{k}' AS kind, count(*) FILTER (contains(text, '{t}')) AS n FROM documents" for t, k in _TOKENS))
def token_policy(spark, sf_dir):
    return audits.token_policy(table(spark, sf_dir, "documents"), "text", [t for t, k in _TOKENS if k == "required"], [t for t, k in _TOKENS if k == "forbidden"])


@query("""SELECT o_orderpriority AS priority, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL""")
def counter_map(spark, sf_dir):
    """Counts of a category as a map, sorted by key, as JSON."""
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))))).alias("counts"))


@query(f"""WITH z AS (SELECT min(ts) + INTERVAL '10 days' AS cutoff FROM events), e AS (SELECT event_type, ts, cutoff FROM events CROSS JOIN z) SELECT event_type, count(*) AS n, count(*) FILTER (ts >= cutoff) AS n_after, strftime(min(CASE WHEN ts >= cutoff THEN ts END), '%Y-%m-%dT%H:%M:%SZ') AS first_after, (max(ts) < max(cutoff)) AS frozen FROM e GROUP BY event_type""")
def freeze_check(spark, sf_dir):
    """Events after a freeze, ten days after the first one; times in UTC."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    freeze = e.agg((F.min("ts") + F.expr("interval 10 days")).alias("freeze"))
    late = F.col("ts") >= F.col("freeze")
    own = e.crossJoin(F.broadcast(freeze)).groupBy("event_type")  # one row
    return own.agg(F.count("*").alias("n"), F.count_if(late).alias("n_after"), F.date_format(F.min(F.when(late, F.col("ts"))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_after"), (F.count_if(late) == 0).alias("frozen"))


@query(f"""{P}, c AS (SELECT arm, condition, count(*) AS n, cast(sum(correct) AS BIGINT) AS k FROM predictions GROUP BY ALL), j AS (SELECT c.*, c.k / c.n AS a, s.k / s.n AS b FROM c JOIN c s ON s.arm = c.arm AND s.condition = 'source')
SELECT arm, condition, format('{{:,}}', n) AS records, k || ' (' || printf('%.1f', 100.0 * k / n) || '%)' AS correct, printf('%.4f', a) AS accuracy,
CASE WHEN printf('%.4f', abs(a - b)) = '0.0000' THEN '0.0000' ELSE printf('%+.4f', a - b) END AS gap, printf('%.4f', a) || ' [' || printf('%.4f', least(a, b)) || ', ' || printf('%.4f', greatest(a, b)) || ']; n=' || n AS range FROM j""")
def public_numbers(spark, sf_dir):
    """A report's cells as they are printed: thousands, counts with shares, signed gaps, intervals."""
    c = predictions(spark, sf_dir).groupBy("arm", "condition").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    base = c.where("condition = 'source'").select("arm", (F.col("k") / F.col("n")).alias("b"))
    j = c.join(base, "arm").withColumn("a", F.col("k") / F.col("n"))
    a, b = F.col("a"), F.col("b")
    return j.select(
        "arm", "condition", text.thousands(F.col("n")).alias("records"), text.count_share(F.col("k"), F.col("n")).alias("correct"), text.fixed(a, 4).alias("accuracy"),
        text.fixed(a - b, 4, signed=True).alias("gap"), text.interval(a, F.least(a, b), F.greatest(a, b), F.col("n")).alias("range"),
    )


ECHO = f"""{TAGGED_SQL}, e AS (SELECT conv_id % 6 AS shape, lower(raw) AS f, lower(answer) AS a FROM tagged), m AS (SELECT shape, (length(f) - length(replace(f, a, ''))) // length(a) AS k FROM e)"""


@query(f"{ECHO} SELECT shape, count(*) AS n, count(*) FILTER (k > 0) AS n_echo, cast(sum(k) AS BIGINT) AS total, bool_or(k > 0) AS any_echo FROM m GROUP BY shape")
def echo_counters(spark, sf_dir):
    """How many generations repeat their answer, how often in all, and if any does."""
    t = tagged(spark, sf_dir).select((F.col("conv_id") % 6).alias("shape"), F.lower("raw").alias("f"), F.lower("answer").alias("a"))
    k = ((F.length("f") - F.length(F.replace(F.col("f"), F.col("a"), F.lit("")))) / F.length("a")).cast("long")
    return t.withColumn("k", k).groupBy("shape").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 0).alias("n_echo"), F.sum("k").alias("total"), F.bool_or(F.col("k") > 0).alias("any_echo"))


_MAGIC = ["89504E470D0A1A0A", "FFD8FFE0", "47494638", "25504446", "49492A00", "4D4D002A", "424D", "3C73766720", ""]
_KINDS = ["png", "jpeg", "gif", "pdf", "tiff", "tiff", "bmp", "svg", None]
_SUFFIXES = ["PNG", "jpg", "gif", "pdf", "tif", "tiff", "bmp", "svg", "png"]


@query("SELECT doc_id, " + f"({_KINDS!r})".replace("None", "NULL") + "[cast(doc_id % 9 + 1 AS INT)] AS kind, doc_id % 9 < 2 AS allowed FROM documents WHERE text IS NOT NULL")
def image_signatures(spark, sf_dir):
    """What documents with an image's first bytes before them are taken for, and if name and kind agree and are allowed."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % 9 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").where("text is not null")
    content = F.concat(F.unhex(pick(_MAGIC)), F.lit("# ").cast("binary"), F.encode("text", "UTF-8"))
    return d.select("doc_id", hashing.signature(content).alias("kind"), hashing.image_allowed(content, F.concat(F.lit("a."), pick(_SUFFIXES))).alias("allowed"))
