"""Queries that read whole texts, beside brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabulon.functions.hashing import SECRETS
from tabulon.operators import bootstrap
from tabulon.plans import queries
from tabulon.plans.queries import FULL_REPS, ORACLE, QUERIES, _battery_stats, _battery_sums
from tests.oracle import assert_same


def documents(path, texts):
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), f"{path}/documents.parquet")
    return str(path)


def test_prompts_hold_whole_texts(spark, tmp_path):
    """A marker after character 80 is a leak, and texts that differ after it are two tasks."""
    same = "word " * 40
    sf = documents(tmp_path, [same + "one", same + "two", same + "Answer: B", None])
    assert {r.arm: (r.n, r.leaks) for r in QUERIES["whole_prompt_sentinel"](spark, sf).collect()} == {"plain": (4, 1), "plain_desc": (4, 1)}
    assert tuple(QUERIES["whole_prompt_task_dedup"](spark, sf).first()) == (8, 8, 0)
    assert {r.arm: (r.n, r.equal) for r in QUERIES["whole_prompt_reconstruction_audit"](spark, sf).collect()} == {"plain": (4, 4), "plain_desc": (4, 4)}


def found(rows):
    """Brute force of the scanner, line by newlines before the match."""
    out = Counter()
    for k, t in rows:
        for kind, pattern in SECRETS.items():
            for m in re.finditer(pattern, t or ""):
                v = m[1] if kind == "credential_assignment" else m[0]
                if kind != "credential_assignment" or not any(x in v for x in ("os.environ", "os.getenv", "YOUR_", "<", "${")):
                    out[k, kind, len(t[: m.start()].split("\n")), hashlib.sha256(v.encode()).hexdigest()[:12]] += 1
    return out


def test_secrets_of_all_kinds_with_lines(spark, tmp_path):
    texts = [
        "a\nb ghp_" + "a1" * 16 + " github_pat_" + "b_" * 22, "hf_" + "Ab1" * 11, "\n\nsk-proj-" + "x-_9" * 7, "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----",
        "AKIA" + "A1B2" * 4 + " twice\nAKIA" + "A1B2" * 4, "see https://x.example/f?a=1&sig=" + "z" * 14, "password =\n 'sixteen letters and more'\nAPI_KEY=\"YOUR_KEY_GOES_IN_HERE\"", "no secret", None,
    ]
    sf = documents(tmp_path, texts)
    got = Counter((r.doc_id, r.type, r.line, r.fingerprint) for r in QUERIES["secret_findings"](spark, sf).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert Counter((r[0], *r[1:]) for r in con.sql(f"select doc_id, type, line, fingerprint from ({ORACLE['secret_findings']})").fetchall()) == got
    assert got == found(enumerate(texts)) and {k[1] for k in got} == set(SECRETS)
    assert (4, "aws_access_key", 2) in {k[:3] for k in got} and not any(k[0] == 6 and k[2] > 1 for k in got)


def drawn(sums, by, reps):
    """How often each replicate takes each cluster, by group and cluster."""
    out = {}
    for r in bootstrap.multinomial_draws(sums, by, sums.columns[len(by)], reps).collect():
        out.setdefault(tuple(r[: len(by) + 1]), np.zeros(reps, np.int64))[r.rep] += r.times
    return out


def test_bootstrap_by_groups(spark):
    """Totals are those of the draws, which are as many as a group has clusters."""
    rows = [("a", k * 3, k + 1, k % 4) for k in range(9)] + [("b", k * 5, 2, k) for k in range(6)]
    df = spark.createDataFrame(rows, "g string, c long, n long, s long")
    got = {(r.g, r.rep): (r.n, r.s) for r in bootstrap.multinomial_replicates(df, ["g"], "c", ["n", "s"], 30).collect()}
    counts = drawn(df, ["g"], 30)
    for g, size in (("a", 9), ("b", 6)):
        own = [r for r in rows if r[0] == g]
        assert (sum(counts.get((g, r[1]), 0) for r in own) == size).all()
        for rep, total in enumerate(sum(np.outer(counts[g, r[1]], r[2:]) for r in own if (g, r[1]) in counts)):
            assert got[g, rep] == tuple(total)


def test_draws_of_many_parts(spark):
    """A tree of 13 parts: each part hears of its own branch alone, and draws add up."""
    df = spark.range(600).select(bootstrap.F.col("id").alias("c"))
    counts = {}
    for r in bootstrap.multinomial_draws(df, [], "c", 200, part_size=48).collect():
        counts.setdefault(r.c, np.zeros(200, np.int64))[r.rep] += r.times
    every = np.array([counts.get(c, np.zeros(200, np.int64)) for c in range(600)])
    assert (every.sum(0) == 600).all() and abs(every.var() - (1 - 1 / 600)) < 0.05
    heads = bootstrap._heads(df.select("c", bootstrap.F.lit(0).alias("g"), bootstrap.F.pmod("c", bootstrap.F.lit(13)).alias("_part"), bootstrap.F.lit(13).alias("_parts")), ["g"]).collect()
    assert len(heads) == 13 and all(len(h.path) == 4 for h in heads)


def test_bootstraps_are_whole(spark, tmp_path):
    """10,000 replicates over all arms and conditions: 50 linear and 2 ratio estimands, the drifts, seven ratios of each judge cell."""
    assert len(_battery_stats()) == 52 and FULL_REPS == 10_000
    n = 40
    pq.write_table(pa.table({"o_orderkey": pa.array(range(n), pa.int64()), "o_custkey": pa.array([k % 12 for k in range(n)], pa.int64()), "o_orderpriority": ["p"] * n, "o_totalprice": [k * 7.5 for k in range(n)]}), f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    battery = {r.statistic: r for r in QUERIES["bootstrap_battery_ci"](spark, sf).collect()}
    assert set(battery) == set(_battery_stats()) and all(r.replicates == 10_000 and r.low <= r.high for r in battery.values())
    sums = {r.frame_id: r for r in _battery_sums(spark, sf).collect()}
    counts = drawn(_battery_sums(spark, sf).select("frame_id"), [], 10_000)
    of = lambda c: sum(counts[(k,)] * r[c] for k, r in sums.items())
    ratio = lambda a: of(f"{a}__turned") / of(f"{a}__source")
    for name, v in {"accuracy plain grey": of("plain__grey") / of("n"), "gap point mask": (of("point__source") - of("point__mask")) / of("n"), "turned_contrast plain_desc plain": ratio("plain_desc") - ratio("plain")}.items():
        assert np.allclose([battery[name].low, battery[name].high], np.quantile(v, [0.025, 0.975]), atol=2e-9)
    judged = QUERIES["judge_bootstrap_ci"](spark, sf).collect()
    assert len(judged) == 4 * 6 * 7 and all(0 < r.replicates <= 10_000 for r in judged)
    assert min(r.p for r in QUERIES["judge_bootstrap_bh"](spark, sf).collect()) >= round(2 / 10_001, 9)


@pytest.mark.parametrize("name", ["bootstrap_battery_ci", "bootstrap_battery_histogram", "drift_bootstrap_ci", "judge_bootstrap_ci", "judge_bootstrap_bh"])
def test_intervals_beside_sql_at_few_replicates(spark, sf, monkeypatch, tmp_path, name):
    """The SQL takes the draws from a table; what it makes of them is its own."""
    monkeypatch.setattr(queries, "FULL_REPS", 12)
    sums, by = (queries._drift_sums(spark, sf), ["arm", "condition"]) if name == "drift_bootstrap_ci" else (_battery_sums(spark, sf), [])
    pq.write_table(bootstrap.multinomial_draws(sums, by, "frame_id", 12).toArrow(), f"{tmp_path}/draws.parquet")
    assert_same(QUERIES[name](spark, sf), queries.interval_sql()[name].replace("FROM draws", f"FROM '{tmp_path}/draws.parquet' draws"), sf)
