"""Operator 4: quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, byte_class, byte_parts, shingle_hashes, span_hashes, spans, table
from .language_id import held_out

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of their id, but for texts of more characters, and only so many bytes of all.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_BYTES = 6000, 50_000, 64 << 20
BITS = 18
EPOCHS = 3
#: Learning rate, its smoothing, and the L1 and L2 weights of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0
THRESHOLD = 0.3

_ODD_PAIR = np.uint64(0xA5A5A5A5A5A5A5A5)
_ALNUM = byte_class(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_MARK = SPACED & ~_ALNUM


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row, rows end to end, and each row's first feature (one more entry than rows).

    Words are runs of letters and digits, and runs of other marks; features are
    single words, and pairs of neighbours. A word after itself is one feature,
    whichever word it is."""
    # a border between the two kinds parts words too: find each kind's runs, merge by start
    s1, e1, _ = spans(_ALNUM[data], offsets)
    s2, e2, _ = spans(_MARK[data], offsets)
    starts = np.concatenate([s1, s2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([e1, e2])[order]
    first = np.searchsorted(starts, offsets)
    words = span_hashes(data, starts, ends)
    pairs, at = shingle_hashes(words, first, 2)
    pairs[words[at] == words[at + 1]] = _ODD_PAIR
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows = np.concatenate([row, row[at]])
    order = np.argsort(rows, kind="stable")
    shift = np.uint64(64 - bits)
    found = np.concatenate([words >> shift, pairs >> shift])[order].astype(np.int64)
    return found, np.searchsorted(rows[order], np.arange(len(first)))


def fit(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """FTRL-proximal over the rows in a seeded order; a document's features weigh count / length."""
    size = 1 << bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias
    docs = []
    for text, y in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        found, _ = features(raw, np.array([0, len(raw)]), bits)
        ix, count = np.unique(found, return_counts=True)
        docs.append((np.append(ix, size), np.append(count / max(1, len(found)) ** 0.5, 1.0), float(y)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ix, x, y = docs[k]
            zi, ni = z[ix], n[ix]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            w[ix] = wi
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[ix] = zi + g - sigma * wi
            n[ix] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """The bounded sample that the driver fits on, at most `most` rows and most_bytes of text.

    Null labels and ids are left out; a null text is empty. A doubly labelled or
    repeated document counts each time, as far as the sample goes. Without
    labels the sample is empty."""
    few = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("_y"))
    few = few.orderBy(F.xxhash64(id_col), F.col(id_col), "_y").limit(most)
    found = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(few), id_col)
    order = [F.xxhash64(id_col), F.col(id_col), F.col("_y"), F.col("_t")]
    usable = found.where(F.coalesce(F.length("_t"), F.lit(0)) <= SAMPLE_CHARS).orderBy(*order).limit(most)
    size = F.sum(F.coalesce(F.octet_length("_t"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return [(r._t or "", r._y) for r in usable.withColumn("_size", size).where(F.col("_size") <= most_bytes).orderBy(*order).collect()]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted. Whole texts count; an empty or null text gets the bias alone. Equal texts get equal scores; null ids and repeated rows come back as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, offsets, data in byte_parts(batch.column(1)):
                found, first = features(data, offsets)
                total = np.concatenate([[0.0], np.cumsum(m.weights[found], dtype=np.float64)])
                length = np.maximum(np.diff(first), 1)
                s = 1 / (1 + np.exp(-np.clip(m.bias + (total[first[1:]] - total[first[:-1]]) / np.sqrt(length), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of those labelled rows whose remainder isn't 0; without any, all scores are 0.5."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    learned = labels.where(~held_out("doc_id", 5, 0))
    model = fit(training_rows(docs, learned, "doc_id", "text", "quality"))
    return score(docs, model).withColumn("held_out", held_out("doc_id", 5, 0))
