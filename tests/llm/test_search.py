"""Ranked search beside brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulon.llm import lexical_search

from . import odd

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def want(docs, items, top=10):
    counts = [(k, Counter(terms(t))) for k, t in docs]
    counts = [(k, c) for k, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        asked = terms(text)
        scores = []
        for k, c in counts:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, k is None, k))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def made(seed=3):
    rng = random.Random(seed)
    words = [odd.word(rng) for _ in range(60)]
    some = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(k, some(rng.randint(1, 40))) for k in range(900)]
    docs += [(900 + k, docs[k % 3][1]) for k in range(60)] + [(5, docs[5][1]), (None, docs[7][1]), (None, None)]  # copies, repeats, no ids
    items = [(k, some(rng.randint(1, 25))) for k in range(12)] + [(3, "another " + docs[3][1]), (20, docs[0][1] * 2), (21, docs[0][1]), (21, docs[0][1]), (22, None), (23, "!! 'zzzz'"), (None, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("short, shard, step", [(None, lexical_search.SHARD, 4096), (0, 700, 16), (10_000, 300, 64), (30, 2000, 8)])
def test_search(spark, monkeypatch, short, shard, step):
    docs, items = made()
    monkeypatch.setattr(lexical_search, "STEP", step)
    got = lexical_search.search(odd.documents(spark, docs), spark.createDataFrame(items, ITEMS), short=short, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == want(docs, items)


def test_blocks_of_terms(spark, monkeypatch):
    docs, items = made(4)
    monkeypatch.setattr(lexical_search, "TERMS", 7)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 20)
    got = lexical_search.search(odd.documents(spark, docs), spark.createDataFrame(items, ITEMS))
    assert Counter(tuple(r) for r in got.collect()) == want(docs, items)


def test_odd_rows(spark):
    data = odd.rows()
    items = [(k, t) for k, t in data if t and len(t) < 3000][:20]
    got = lexical_search.search(odd.documents(spark, data), spark.createDataFrame(items, ITEMS))
    assert Counter(tuple(r) for r in got.collect()) == want(data, items)
    assert lexical_search.search(odd.empty(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical_search.search(odd.documents(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert lexical_search.search(odd.documents(spark), spark.createDataFrame([(1, "")], ITEMS)).count() == 0


def test_steps_that_cannot_reach_the_top_are_skipped(monkeypatch):
    """Documents of the later steps have only the common term: none of them is looked at."""
    rng = np.random.default_rng(1)
    n, monkeyed = 4000, []
    terms_of = [np.array([1, 2] if k < 40 else [1], np.int64) for k in range(n)]
    rows = [(np.arange(n), np.zeros(n, bool), rng.integers(5, 9, n), np.concatenate(terms_of), np.ones(sum(map(len, terms_of)), np.int64), np.array([len(t) for t in terms_of]))]
    ix = lexical_search.inverted(rows, n, int(rows[0][2].sum()))
    monkeypatch.setattr(lexical_search, "STEP", 100)
    plain = lexical_search.summed
    monkeypatch.setattr(lexical_search, "summed", lambda p, s: monkeyed.append(sum(map(len, p))) or plain(p, s))
    p, s = lexical_search.best(ix, np.array([1, 2]), np.array([3, 4000]))
    assert len(p) == 10 and p.max() < 40
    assert sum(monkeyed) < 200
    by = defaultdict(int)
    for t, w in ((1, 3), (2, 4000)):
        a, b, _ = ix.of(t)
        for x, i in zip(ix.places[a:b].tolist(), ix.impacts[a:b].tolist(), strict=True):
            by[x] += w * i
    assert [(-v, k) for k, v in zip(p.tolist(), s.tolist(), strict=True)] == sorted((-v, k) for k, v in by.items())[:10]
