"""The prefix trie of conversations, beside brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import prefix_trie
from tabulon.operators import joins

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows, splice=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if splice else 0
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(sums[k][0] for k in kids[p]) if kids[p] else 1
        sums[p] = leaves, (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids[p])
    out = Counter()
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ms if built[c] == p))
        out[min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def made(seed=1, n=130):
    rng = random.Random(seed)
    say = [" ".join("abcdefgh"[rng.randrange(8)] for _ in range(rng.randint(0, 6))) for _ in range(4)]
    rows = []
    for c in [*range(0, n), 1000, 1001, 1019, -7, -20, 2**40]:
        if c == 40:
            continue  # a base that isn't there
        for k in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, k * 3, rng.choice(["user", "assistant"]), say[rng.randrange(4)] if rng.random() < 0.8 else f"own {c} {k}"))
    copies = [(k, rng.choice(["user", None]), rng.choice(["same words", None, "é x \t y"])) for k in range(12)]
    rows += [(2000 + c, k, role, text) for c in range(30) for k, role, text in copies]  # a group of copies
    rows += [(5000, k, "user", f"turn {k % 3}") for k in range(150)] + [(5001, k, "user", f"turn {k % 3}") for k in range(140)]  # long ones
    rows += [(6000, None, "user", "first"), (6000, 1, "user", "tied"), (6000, 1, "user", "tied"), (6001, None, "user", "first"), (None, 0, "user", "nobody's")]
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("conv", "pos", "ka", "pa", "depth", "n_convs", "words", "length", "pid", "owner")})


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in df.collect())


def test_whole_trees_in_tasks(spark):
    rows = made()
    assert found(prefix_trie.conversations_trie(table(spark, rows))) == want(rows)
    assert found(prefix_trie.conversations_trie(table(spark, rows), as_given=True)) == want(rows, splice=False)


@pytest.mark.parametrize("component, block, hot", [(40, 16, 1 << 17), (9, 5, 6)])
def test_large_trees_are_split_by_joins(spark, monkeypatch, component, block, hot):
    """Every large tree, long conversation and hot key goes the way of those beyond a task's bound."""
    monkeypatch.setattr(joins, "KEY_ROWS", hot)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "TOGETHER", 10)
    rows = [r for r in made(2, 40) if r[0] not in (5001,)]
    assert found(prefix_trie.conversations_trie(table(spark, rows), component=component, block=block)) == want(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.conversations_trie(table(spark, [])).count() == 0
    assert prefix_trie.conversations_trie(table(spark, [(None, 0, "user", "x")])).count() == 0
    rows = [(c, 0, "user", "gone") for c in (41, 42, 43, 44, 45)]  # their base isn't there: some have no turn left
    got = found(prefix_trie.conversations_trie(table(spark, rows)))
    assert got == want(rows)
    lost = [c for c in (41, 42, 43, 44, 45) if zlib.crc32(str(c).encode()) % 4]
    assert lost and (41, 0, None, 5, 1 if len(lost) < 5 else 0, 1, max(0, 4 - len(lost)), hashlib.sha256(",".join(map(str, lost)).encode()).hexdigest()) in got


def test_decomposed():
    rng = np.random.default_rng(3)
    for n, far in ((1, 1), (2, 1), (300, 1), (300, 3), (500, 500), (2000, 40)):
        parent = np.array([-1 if k == 0 or rng.random() < 0.01 else max(0, k - 1 - int(rng.integers(0, far))) for k in range(n)])
        depth = np.zeros(n, np.int64)
        for k in range(n):
            depth[k] = 1 if parent[k] < 0 else depth[parent[k]] + 1
        values = rng.integers(-1000, 1000, (n, 2))
        sums = values.copy()
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                sums[parent[k]] += sums[k]
        mixed = rng.permutation(n)  # nodes in any order
        back = np.argsort(mixed)
        up = np.where(parent[mixed] >= 0, back[parent[mixed]], -1)
        assert (prefix_trie.decomposed(up, depth[mixed], values[mixed]) == sums[mixed]).all()


def test_a_chain_falls_into_halves(monkeypatch):
    """A conversation of many turns takes rounds as the logarithm of its length."""
    n, rounds = 1 << 14, []
    plain = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    out = prefix_trie.decomposed(np.arange(n) - 1, np.arange(n), np.ones((n, 1), np.int64))
    assert (out[:, 0] == np.arange(n, 0, -1)).all() and len(rounds) <= 15
