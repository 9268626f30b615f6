"""Personal data: base patterns beside plain regular expressions, the field beside all divisions, held-out islands."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.llm import pii

from . import odd

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


@pytest.fixture(scope="module")
def model():
    return pii.fit([])


def valid(k, s):
    d = [int(c) for c in s if c in "0123456789"]
    if k == 1:
        return all(int(x) <= 255 for x in s.split("."))
    if k == 2:
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return k == 0 or 9 <= len(d) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if valid(k, m[0]))


def made(seed=2, n=400):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", ".", "-", " ", "  ", "+", "+1", "(", ")", "1", "12", "255", "256", "0001", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "é", "日本", "\n", "555-1234", "(at)", "%", "_", "999999999"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(n)] + [t for t, _, _ in pii.made_islands(77, n)]


def test_base_patterns():
    for text in made():
        assert pii.base_spans(text) == plain(text), text


def divisions(x, k=0):
    """All divisions from token k on: lists of (begin, end, kind, key)."""
    n = len(x.ending) - 1
    if k == n:
        yield []
        return
    for rest in divisions(x, k + 1):
        yield rest
    for j in range(k + 1, n + 1):
        for i, key in x.ending[j]:
            if i == k:
                for rest in divisions(x, j):
                    for kind in range(len(pii.KINDS)):
                        yield [(i, j, kind, key), *rest]


def total(d, model):
    s = 0.0
    for n, (i, j, k, key) in enumerate(d):
        s += model.scores(key)[k] + (model.next_to[k] if n and d[n - 1][1] == i else 0.0)
    return s


def test_field_beside_all_divisions(model):
    rng = random.Random(4)
    islands = ["1.2.3.4", "a@b.cc", "1.2.3.45", "555-123-4567", "a@b.c1", "(1) 2345678", "+12 3456789", "x@y.zz7@q.rr"]
    assert any(pii.lattice(t, "").ending for t in islands)
    for text in islands:
        x = pii.lattice(text, "")
        every = list(divisions(x))
        assert len(every) < 200_000
        odd_one = pii.Field({f: [rng.uniform(-1, 1) for _ in pii.KINDS] for e in x.ending for _, key in e for f in pii.features(key)}, [rng.uniform(-1, 1) for _ in pii.KINDS])
        for m in (model, odd_one):
            scores = [total(d, m) for d in every]
            z = math.log(sum(math.exp(s) for s in scores))
            got = pii.decode(x, m)
            at = {a: k for k, a in enumerate(x.at)}
            keys = {(i, j): key for j, e in enumerate(x.ending) for i, key in e}
            assert total([(at[a], at[b], k, keys[at[a], at[b]]) for a, k, b, _ in got], m) == pytest.approx(max(scores))
            share = Counter()
            for d, s in zip(every, scores, strict=True):
                for i, j, k, _ in d:
                    share[i, j, k] += math.exp(s - z)
            for i, j, k, p, _ in pii.expected(x, m):
                assert p == pytest.approx(share[i, j, k], abs=1e-9)


def test_held_out_islands(model):
    right = wrong = missed = 0
    for text, before, spans in pii.made_islands(9, 1000):
        got = {(a, k, b) for a, k, b, s in pii.decode(pii.lattice(text, before), model) if s >= pii.MARGIN}
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


def test_what_the_field_adds(model):
    cases = [("call (020) 555-1234 now", [(5, 3, 19)]), ("mail jane (at) example.com today", [(5, 0, 26)]), ("4111111111111112 4111111111111111", [(17, 2, 33)]), ("+1 (826) 555-4081 190.137.223.204", [(0, 3, 17)])]
    for text, want in cases:
        base, added = pii.spans_of(text, model)
        assert base == plain(text) and added == want, text
    for text in ["version 4.0.", "on 2024-01-02 at 10:20:30", "It cost 1,234,567.89.", "4111111111111112", "token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\"", "1.2.3.4.5 is no address"]:
        base, added = pii.spans_of(text, model)
        assert base == plain(text) and not added, text


def test_odd_rows(spark, model):
    data = [*odd.rows(), (100, "é 4111111111111111, a.b@c.dd!"), (100, "é 4111111111111111, a.b@c.dd!"), (101, "10.0.0.1 " * 3000), (102, "1" * 300_000), (103, "@" * 100_000 + "a" * 100_000 + "." * 100_000)]
    docs = odd.documents(spark, data).withColumn("spans", F.lit("clash"))
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.kept) for r in pii.personal_data(docs, model, carry=("kept",)).collect())
    want = Counter()
    for k, t in data:
        spans = pii.base_spans(t or "") if len(t or "") > 50_000 else plain(t or "")
        count = Counter(s[1] for s in spans)
        want[k, *(count[i] for i in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in spans).encode()).hexdigest(), "clash"] += 1
    assert got == want
    text = {r.doc_id: r.redacted for r in pii.personal_data(docs, model, with_text=True).where("doc_id = 100").collect()}
    assert text == {100: "é [card], [email]!"}
    assert pii.personal_data(odd.empty(spark), pii.learn(odd.empty(spark), made=50)).count() == 0


def test_long_texts_take_linear_time(model):
    for text in ["a" * 400_000, "1" * 400_000, "1 " * 100_000, "1.1.1." * 40_000, "+1" * 100_000, "+1" + " " * 300_000, "a@" * 100_000, "a@b." * 60_000, "@" * 300_000, "5 (at) " * 30_000]:
        began = time.process_time()
        base, added = pii.spans_of(text, model)
        assert time.process_time() - began < 25, text[:9]
        assert all(a < b for a, _, b in base + added)


def test_the_sample_is_the_same_whatever_the_partitions(spark):
    docs = odd.documents(spark, [(k, t) for k, (t, _, _) in enumerate(pii.made_islands(5, 300))])
    one, two = pii.learn(docs.coalesce(1), sample=50, made=60), pii.learn(docs.repartition(7), sample=50, made=60)
    assert one.weights == two.weights
