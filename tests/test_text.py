import math
import random
import re
import unicodedata
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions import hashing, text
from tabulon.operators import pairs

SPANS = [
    ("<reasoning>a b.</reasoning><final>c</final>", "a b.", "c"),
    ("< Reasoning >\n a  b </REASONING > <FINAL> c </FINAL>", "a b", "c"),
    ("<reasonning>a b <final'>c", "a b", "c"),
    ("<final) the man sits", "", "the man sits"),
    ("<reasoning>a</reasoning><final></final>", "a", ""),
    ("<reasoning>a</reasoning>", "a", ""),
    ("One thing. Another thing.", "One thing.", "Another thing."),
    ("Only one thing.", "", "Only one thing."),
    ("", "", ""),
    (None, "", ""),
]


def test_parse_tolerant(spark):
    df = spark.createDataFrame([(k, s[0]) for k, s in enumerate(SPANS)], "k int, t string").select("k", text.parse_tolerant(F.col("t")).alias("p"))
    got = {r.k: (r.p.reasoning, r.p.final) for r in df.collect()}
    assert [got[k] for k in range(len(SPANS))] == [s[1:] for s in SPANS]


def test_parse_strict(spark):
    rows = [("<reasoning>a</reasoning><final></final>", "both"), ("<final>x</final>", "final_only"), ("<reasoning>a", "none"), (None, "none")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", text.parse_strict(F.col("t"))["status"].alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_mask_longest_first(spark):
    df = spark.createDataFrame([("The Red  CAR and the red", ["red", "the red car", None, ""])], "t string, c array<string>")
    r = df.select(text.mask_choices(F.col("t"), F.col("c")).alias("m")).first().m
    assert r.masked == "<ANSWER_CHOICE_1> and the <ANSWER_CHOICE_0>" and r.matches == [1, 0]


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("a", "", 0.0), ("a b", "b c", 1 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b")))).first()[0] == pytest.approx(want)


def want_bleu(reference, candidate):
    a, b = (reference or "").split(), (candidate or "").split()
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = (Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b))
        hits = sum((x & y).values())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / max(1, sum(y.values()))) / 4
    return math.exp(logs + min(0.0, 1 - len(a) / len(b)))


def test_bleu(spark):
    rng = random.Random(2)
    some = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
    rows = [("a b c d e", "a b c d e"), ("a", ""), ("a b c d", "x y"), (None, "a"), (None, None), ("a b c d e f", "a b c"), ("a " * 5000, "a " * 4000 + "b")] + [(some(), some()) for _ in range(60)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    got = {r.k: r.bleu for r in pairs.sentence_bleu(df, "k", "a", "b").collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        assert got[k] == pytest.approx(want_bleu(*r)), r
    # three words of six: full 1-, 2- and 3-grams, no 4-gram
    assert got[5] == pytest.approx(math.exp(math.log(0.1) / 4 + 1 - 2))
    plan = pairs.sentence_bleu(df, "k", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nfkc_of_all_code_points(spark):
    """Alone, and between letters with a mark, as the standard library has it; code points newer than its tables aside."""
    points = [k for k in range(1, 0x110000) if not 0xD800 <= k <= 0xDFFF and unicodedata.category(chr(k)) != "Cn"]
    data = [(k, chr(k)) for k in points] + [(-k, f"e{chr(k)}\u0301 \u1100{chr(k)}\u11a8") for k in points[::7]]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["k", "t"]))
    got = df.select("k", "t", text.nfkc(F.col("t")).alias("n"), text.match_form(F.col("t")).alias("m"), F.col("t").rlike(r"\p{Cn}").alias("newer")).toPandas()
    for k, t, n, m, newer in got.itertuples(index=False):
        assert n == unicodedata.normalize("NFKC", t), k
        if k > 0 and not newer:  # which code points are letters is of the regular expressions' own version
            assert m == " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", t).lower()).split()), (k, m)


def want_masked(t, choices):
    out, hit = unicodedata.normalize("NFKC", t or ""), []
    choices = [c or "" for c in choices or []]
    for k in sorted(range(len(choices)), key=lambda k: -len(unicodedata.normalize("NFKC", choices[k]))):
        words = unicodedata.normalize("NFKC", choices[k]).split()
        if words:
            out, n = re.subn(r"\s+".join(map(re.escape, words)), f"<ANSWER_CHOICE_{k}>", out, flags=re.IGNORECASE)
            hit += [k] * n
    return out, hit


def test_masks_as_patterns_do(spark):
    rows = [("a.b A.B axb", ["a.b", "b"]), ("x\\E(y) \\Q X\\e(Y)", ["x\\E(y)", "\\Q"]), ("ÉTÉ\u00a0 été e\u0301te\u0301", ["été été", "ÉTÉ"]), ("ﬁne ＦＩＮＥ", ["fine", " "]), ("$1 \\1 [x]", ["$1", "[x]", "\\1"]), (None, ["a"]), ("a", None), ("tie one tie two", ["tie two", "tie one", None, "tie"]), ("tab\there\x1fthere", ["tab here there"])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, c array<string>")
    got = {r.k: (r.m.masked, r.m.matches) for r in df.select("k", text.mask_choices(F.col("t"), F.col("c")).alias("m")).collect()}
    for k, r in enumerate(rows):
        assert got[k] == want_masked(*r), r


def test_references(spark):
    df = spark.createDataFrame([(["0", "sees", "7", "1"], ["man", "car"])], "w array<string>, n array<string>")
    out = df.select(text.render_references(F.col("w"), F.col("n")).alias("t"), "n")
    r = out.select("t", text.references(F.col("t"), F.col("n")).alias("m")).first()
    assert r.t == "man_0 sees 7 car_1" and r.m == ["man_0", "car_1"]


def test_secret_is_a_fingerprint(spark):
    value = "AKIA" + "A1" * 8
    df = spark.createDataFrame([(f"x {value} y", ), ("nothing",), (None,)], "t string").select(hashing.secrets(F.col("t")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got[0][0].type == "aws_access_key" and len(got[0][0].fingerprint) == 12 and value not in str(got[0])
    assert got[1] == [] and not got[2]


def test_signature(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0000"),), (bytearray(b"\xff\xd8\xff\xe0abcdefgh"),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"text"),)], "b binary")
    assert [r[0] for r in df.select(hashing.signature(F.col("b"))).collect()] == ["png", "jpeg", "webp", None]


def test_small_functions(spark):
    one = spark.range(1)
    row = one.select(
        hashing.without_hash_prefixes(F.lit("0123abcd_89ef0123_img.jpg")).alias("name"),
        text.duration(F.lit(4983)).alias("time"),
        text.cot_target(F.lit("One. Two. Three.")).alias("cot"),
        text.tex(F.lit("a_b & 5%")).alias("tex"),
    ).first()
    assert row.name == "img.jpg" and row.time == "1h 23m 3s" and tuple(row.cot) == ("One. Two.", "Three.") and row.tex == r"a\_b \& 5\%"
    got = {r.h for r in spark.createDataFrame([(2, "b"), (1, "a")], "o int, v string").select(hashing.sha_of_rows(F.col("o"), F.col("v")).alias("h")).collect()}
    import hashlib

    assert got == {hashlib.sha256(b"a\nb").hexdigest()}
