"""Operator 1: language identification by compression with per-language dictionaries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, release, table

#: Sample that the dictionaries are made of: documents a language, characters of each at most, and bytes of each dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 64, 50_000, 64 << 10
#: Bytes of text compressed at once, so that a dictionary weighs as much at the end of a long text as at its start.
BLOCK = 8 << 10
#: Lazy matching with short matches, as words of one language share short strings.
PACKING = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "target_length": 16}
#: The share of its size by which the best language must beat the second one.
MARGIN = 0.002
UNKNOWN = "und"


def training_sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """At most per_lang documents for each language, by a hash of their ids; those of a few hundred to a few thousand characters first, those above SAMPLE_CHARS never.

    Spark keeps the first rows of each language per partition before it shuffles, so one common language doesn't land in one task."""
    size = F.length(text_col)
    order = Window.partitionBy(lang_col).orderBy(((size < 300) | (size > 4000)), F.xxhash64(F.col(id_col)), F.col(text_col))
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & size.between(1, SAMPLE_CHARS))
    return usable.select(id_col, F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.row_number().over(order).alias("_k")).where(F.col("_k") <= per_lang).select("lang", "text")


def dictionaries(sample: DataFrame, counts: DataFrame, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw content for each language: its sample end to end, languages with most documents (counts: lang, n) first; of equal numbers, by name.

    A language's sample is at most SAMPLE_DOCS texts, so it is put together in
    one group; the driver gets size bytes of each language."""

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        texts = sorted(group.column("text").to_pylist())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "content": pa.array([b"\n".join(map(normal, texts))[:size]], pa.binary())})

    content = {r.lang: bytes(r.content) for r in sample.groupBy("lang").applyInArrow(joined, "lang string, content binary").collect()}
    n = {r.lang: r.n for r in counts.collect()}
    return {lang: content[lang] for lang in sorted(content, key=lambda x: (-n[x], x))}


_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased words of letters with single spaces: marks and digits say little about a language."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    """The whole text in pieces of even length, none longer than size."""
    n = -(-len(data) // size)
    return [data[a:b] for a, b in pairwise([len(data) * k // n for k in range(n + 1)])]


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text) or any(unicodedata.category(c)[0] == "L" for c in text)


def predict(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, lang_pred, score, margin, rejected, and the columns to carry.

    lang_pred is the language whose dictionary compresses the whole text to the
    fewest bytes; of equal ones the one with most documents. Texts of all sizes
    are packed in the same way, in blocks. A text that is null or has no letters
    is 'und' with score 0, rejected; without dictionaries every text is.
    rejected also holds where the margin is narrow. score is 1 / (1 + the other
    languages' odds), from the bytes saved. Rows aren't moved: repeated rows and
    null ids come back as they are."""
    names = list(dicts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = []
        for n in names:
            d = zstandard.ZstdCompressionDict(dicts[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters(**PACKING, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=settings)
            packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress)
        for batch in batches:
            langs, scores, margins, rejected = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                if not packers or not has_letters(text):
                    langs.append(UNKNOWN), scores.append(0.0), margins.append(0.0), rejected.append(True)
                    continue
                data = normal(text) or text.encode()
                pieces = blocks(data)
                sizes = np.array([sum(len(pack(p)) for p in pieces) for pack in packers], float)
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                gap = float(rest.min() - sizes[best]) / float(rest.min()) if len(rest) else 1.0
                langs.append(names[best])
                scores.append(float(1 / (1 + np.exp2(-8 * np.minimum(rest - sizes[best], 100)).sum())))
                margins.append(gap)
                rejected.append(gap < margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_()), *batch.columns[2:]],
                ["doc_id", "lang_pred", "score", "margin", "rejected", *carry],
            )
        release()

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *carry).mapInArrow(
        scored, "doc_id long, lang_pred string, score double, margin double, rejected boolean" + carried(docs, carry)
    )


def held_out(id_col: str, parts: int, part: int):
    """If a row's crc32(id as text) leaves this remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """The dictionaries of the languages that docs names; empty where it names none."""
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    return dictionaries(training_sample(docs, text_col, lang_col, id_col), counts)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict() on all documents, learned from rows with an id whose remainder isn't 2. Equal texts get equal results; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(~held_out("doc_id", 4, 2) & F.col("doc_id").isNotNull())
    found = predict(docs, learn(learned))
    return found.withColumn("held_out", held_out("doc_id", 4, 2))
