"""Operators that look at one row at a time, beside plain Python."""

import functools
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from tabulon.llm import bpe, language_id, licenses, quality_classifier, quality_rules

from . import odd


def by_id(df, column="doc_id"):
    """Rows by id, as often as they occur."""
    out = defaultdict(list)
    for r in df.collect():
        out[r[column]].append(r)
    return out


def inputs():
    out = defaultdict(list)
    for k, t in odd.rows():
        out[k].append(t)
    return out


def want_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark):
    got = by_id(quality_rules.quality_rules(odd.documents(spark)))
    for k, texts in inputs().items():
        assert sorted(tuple(r[1:6][i] if False else r[c] for i, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got[k]) == sorted(want_rules(t or "") for t in texts)
        for r in got[k]:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and not r.failed)
    assert quality_rules.quality_rules(odd.empty(spark)).count() == 0


def test_quality_rules_stay_native(spark):
    plan = quality_rules.quality_rules(odd.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_bpe_is_what_the_library_gives(spark):
    library = Tokenizer.from_file(bpe.default_path())
    got = by_id(bpe.bpe_tokens(odd.documents(spark)))
    for k, texts in inputs().items():
        want = []
        for t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
        assert sorted(tuple(r)[1:] for r in got[k]) == sorted(want)
    assert bpe.bpe_tokens(odd.empty(spark)).count() == 0


def test_bpe_on_random_strings():
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path())
    rng = random.Random(4)
    for letters in ("ab", "the in", "aeiou\n\t  '12s", "éß日😀<|endoftext|>\x00\x85", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(400):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
            assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    t = "x<|endoftext|>y<|endoftext|>"
    assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert own.decode(own.encode(t)) == t.encode()


def test_licenses(spark):
    texts = [
        "Released UNDER the MIT-License, under the mit license.", "Apache License, Version 2.0 applies", "cc by-nc", "cc byé nc", None, "", "under the mit",
        "x " * 50 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Redistribution and use in source and binary forms, with some changes, are permitted provided that the following conditions are met",
        "under the mit license " * 3,
    ]
    got = by_id(licenses.license_scan(odd.documents(spark, list(enumerate(texts)))))
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at, labels = [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        r = got[k][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[7][0].labels == "mit" and got[7][0].spans[0]["first"] == 50 and got[7][0].score == pytest.approx(1.0)
    assert got[8][0].labels == "bsd" and 0.6 <= got[8][0].score < 1
    assert got[6][0].labels == ""
    assert licenses.license_scan(odd.empty(spark)).count() == 0


def longest_suffixes(template, words):
    """By dynamic programming: for each word, how many words up to it stand in the template, and where they end there."""
    out, before = [], [0] * len(template)
    for w in words:
        now = [(before[i - 1] if i else 0) + 1 if c == w else 0 for i, c in enumerate(template)]
        out.append((max(now, default=0), now))
        before = now
    return out


def runs(template, words):
    """All (last word, words, last word of the template) of equal runs that go on neither before nor after."""
    out = []
    for i, w in enumerate(words):
        for e, t in enumerate(template):
            if w == t and (i + 1 == len(words) or e + 1 == len(template) or words[i + 1] != template[e + 1]):
                n = 1
                while n <= min(i, e) and words[i - n] == template[e - n]:
                    n += 1
                if n >= licenses.LEAST:
                    out.append((i, n, e))
    return out


def most_covered(template, words, low, high):
    """The most words that one chain within words low to high covers, by trying each way on from each equal pair: nothing here knows matches or spans."""
    own = {(i - d, e - d) for i, n, e in runs(template, words) for d in range(n)}
    own = {(i, e) for i, e in own if low <= i <= high}

    @functools.cache
    def onward(i, e):
        return 1 + max((onward(j, f) for j in range(i + 1, i + licenses.GAP + 1) for f in range(e + 1, len(template)) if (j, f) in own), default=0)

    return max((onward(i, e) for i, e in sorted(own, reverse=True)), default=0)


def test_automaton_against_all_substrings():
    rng = random.Random(1)
    lists = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(5)]
    a = licenses.Automaton()
    for k, x in enumerate(lists):
        a.add(k, x)
    for k, x in enumerate(lists):
        a.mark(k, x)
    for _ in range(200):
        w = [rng.randrange(4) for _ in range(20)]
        assert sorted(a.matches(w)) == sorted((i, n, k, e) for k, x in enumerate(lists) for i, n, e in runs(x, w))


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_spans_by_brute_force(spark):
    """In texts made of whole, cut and changed templates and of odd rows: a template has a span where some chain covers enough, and each span is what a best chain in it covers."""
    rng = random.Random(17)
    templates = (("a", "x1 x2 x3 x4 x5 x6 x7 x8"), ("b", "x3 x4 x5 x6"), ("c", "x1 x2 y1 y2 x1 x2 y1 y2"), *licenses.TEMPLATES)
    texts = ["x1 x2 x3 x4 x5 x6"]
    for _ in range(110):
        words = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(templates)[1].split()
            w = w[rng.randrange(len(w)) if rng.random() < 0.3 else 0 :]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w)) :][:1] = [rng.choice(["zz", "the", "of"])]
            words += w + ["q"] * rng.choice([0, 1, 9])
        texts.append(" ".join(words))
    data = [*enumerate(texts), *((1000 + k, t) for k, (_, t) in enumerate(odd.rows()))]
    got = by_id(licenses.license_scan(odd.documents(spark, data), templates=templates))
    for k, t in data:
        w = license_words(t)
        spans_ = Counter((x["label"], x["first"], x["last"], round(x["covered"], 9)) for x in got[k][0].spans)
        if not w or len(w) > 3000:
            assert not spans_
            continue
        allowed = Counter()
        for label, own in ((label, x.split()) for label, x in templates):
            enough = licenses.COVER * len(own)
            mine = [x for x in spans_ if x[0] == label and round(most_covered(own, w, x[1], x[2]) / len(own), 9) == x[3] and x[3] * len(own) >= enough - 1e-6]
            assert bool(mine) >= (most_covered(own, w, 0, len(w)) >= enough), (k, label)
            allowed.update(mine)
        assert not spans_ - allowed, (k, spans_ - allowed)
        if not got[k][0].n_base:
            assert got[k][0].labels == ",".join(sorted({x[0] for x in spans_})) and got[k][0].score == pytest.approx(max((x[3] for x in spans_), default=0.0))
    assert {x["label"] for x in got[0][0].spans} == {"a", "b"}


def test_fragments_before_a_license_cost_nothing(spark):
    """Each run of three words of each template, with up to six words after it, stands before the whole template."""
    data, want = [], []
    for label, t in licenses.TEMPLATES:
        w = t.split()
        for k in range(len(w) - 2):
            data.append((len(data), " ".join([*w[k : k + 3], *["qq"] * (k % 7), t])))
            want.append((label, 3 + k % 7, len(w)))
    got = by_id(licenses.license_scan(odd.documents(spark, data)))
    for k, (label, first, n) in enumerate(want):
        assert any(x["label"] == label and x["covered"] == 1 and first - 9 <= x["first"] <= first and x["last"] >= first + n - 1 for x in got[k][0].spans), data[k]


def test_copies_of_a_license_are_spans_of_their_own(spark):
    t = licenses.TEMPLATES[1][1]
    n = len(t.split())
    got = by_id(licenses.license_scan(odd.documents(spark, [(0, " ".join([t] * 400)), (1, " ".join(["the software"] * 20_000))])))
    assert [(x["first"], x["last"]) for x in got[0][0].spans if x["label"] == "mit"] == [(k * n, k * n + n - 1) for k in range(400)]
    assert not got[1][0].spans


def test_language_id(spark):
    rng = random.Random(8)
    sounds = {"aa": ("bcd", "aeo"), "bb": ("wxz", "uiy")}

    def text(lang, n):
        c, v = sounds[lang]
        return " ".join("".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(n))

    data = [(k, text(lang, rng.randint(20, 200)), lang) for k, lang in enumerate(["aa"] * 60 + ["bb"] * 40)]
    learned = spark.createDataFrame(data, "doc_id long, text string, lang string")
    dicts = language_id.learn(learned)
    assert list(dicts) == ["aa", "bb"]
    tests = [(k, text(lang, 40), lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    got = by_id(language_id.predict(odd.documents(spark, [(k, t) for k, t, _ in tests]), dicts))
    assert all(got[k][0].lang_pred == lang and not got[k][0].rejected and 0 <= got[k][0].score <= 1 for k, _, lang in tests)
    odd_rows = by_id(language_id.predict(odd.documents(spark, [(0, None), (1, ""), (2, "123 !!!"), (3, "éé 日本"), (4, text("aa", 90_000))]), dicts))
    assert [odd_rows[k][0].lang_pred for k in range(3)] == ["und"] * 3 and all(odd_rows[k][0].rejected for k in range(3))
    assert odd_rows[3][0].lang_pred in dicts and odd_rows[4][0].lang_pred == "aa"
    assert by_id(language_id.predict(odd.documents(spark, [(0, "abc")]), {}))[0][0].lang_pred == "und"
    assert language_id.predict(odd.empty(spark), dicts).count() == 0


def test_language_id_held_out(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in language_id.op1_language_id(spark, sf).collect() if r.held_out]
    assert len(got) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) >= 0.95


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_classifier.op4_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) >= 0.97
    good, bad = ([r.score for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) >= 0.98


def test_classifier_on_odd_rows(spark):
    rng = random.Random(3)
    model = quality_classifier.fit([(odd.prose(rng, 50), 1) for _ in range(60)] + [(" ".join(["zz ***"] * 30), 0) for _ in range(60)])
    got = by_id(quality_classifier.score(odd.documents(spark), model))
    assert sum(map(len, got.values())) == len(odd.rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for rs in got.values() for r in rs)
    empty_scores = {r.score for k, texts in inputs().items() for r, t in zip(got[k], texts, strict=True) if len(texts) == 1 and not (t or "").strip()}
    assert len(empty_scores) == 1
    assert quality_classifier.score(odd.empty(spark), model).count() == 0
    assert quality_classifier.fit([]).bias == 0.0


def test_repeated_rows_stay(spark):
    n = Counter(k for k, _ in odd.rows())
    assert Counter(r.doc_id for r in bpe.bpe_tokens(odd.documents(spark), with_ids=False).collect()) == n


def test_training_rows(spark):
    """Nulls, labels given twice, repeated documents, long texts and no labels at all; bounds hold."""
    docs = odd.documents(spark, [(1, "one"), (1, "one"), (2, None), (3, "three"), (None, "x"), (4, "y" * 60_000), (5, "five")]).withColumn("quality", quality_classifier.F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 1), (6, 1)], "doc_id long, quality int")
    rows = lambda **most: quality_classifier.training_rows(docs, labels, "doc_id", "text", "quality", **most)
    assert Counter(rows()) == Counter({("one", 1): 2, ("one", 0): 2, ("", 0): 1})
    assert len(rows(most=2)) <= 2 and sum(len(t) for t, _ in rows(most_bytes=7)) <= 7
    assert quality_classifier.training_rows(docs, labels.limit(0), "doc_id", "text", "quality") == []
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit([])).collect()} == {0.5}


def test_language_ties_and_nulls(spark):
    """Rows without a text or language teach nothing; of languages with equal texts the more frequent one is named, and rejected."""
    text = "some words that both languages have " * 20
    learned = spark.createDataFrame([(1, text, "bb"), (2, text, "aa"), (3, text, "aa"), (None, text, "aa"), (4, None, "cc"), (5, text, None)], "doc_id long, text string, lang string")
    dicts = language_id.learn(learned)
    assert list(dicts) == ["aa", "bb"]
    got = language_id.predict(odd.documents(spark, [(1, text), (1, text), (None, text)]), dicts).collect()
    assert len(got) == 3 and {(r.lang_pred, r.rejected) for r in got} == {("aa", True)}
    assert language_id.learn(learned.where("lang is null")) == {}
