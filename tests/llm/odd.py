"""Small tables with what real ones hold: nulls, empty and long texts, repeated rows, columns with clashing names."""

import random

from pyspark.sql import functions as F

VOWELS, OTHERS = "aeiou", "bcdfghklmnprst"
#: Names that operators use inside, or for their results.
CLASHES = ("fp", "node", "cell", "component_id", "g", "kind", "_words", "_text", "score", "lang_pred", "held_out", "n_words", "bucket", "host", "part", "n_tokens", "kept")


def word(rng):
    return "".join(rng.choice(OTHERS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n)).capitalize() + "."


def rows(seed=5):
    rng = random.Random(seed)
    shared = prose(rng, 70)
    near = prose(rng, 300)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(20)]
    texts += [None, "", " \n\t ", "x", "word", "!!! ### ***", "12345", "é" * 60, "日本語のテキスト " * 9, "a" * 400, "ab" * 300]
    texts += [near, near.replace(near.split()[40], "zzz", 1), near + " and", near, near]
    texts += [f"{prose(rng, 30)} {shared} {prose(rng, 30)}" for _ in range(4)] + [shared[:49], shared[:50], shared[3:53] + "\x00"]
    texts += ["same line here\n" * 8, " ".join([word(rng)] * 60), prose(rng, 40_000), "퟿\U0001f600 mixed \x85 text"]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "a row without an id, of some length, that is there once"), (None, None)]


def documents(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | {c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return documents(spark, [])
