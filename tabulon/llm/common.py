"""Helpers that the corpus operators share: tables, lineage cuts, byte arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import spread_join
from ..sources.scratch import folder, forget, shared, tables_made, written

__all__ = ["folder", "forget", "shared", "spread_join", "tables_made", "written"]

#: Bytes of text that one step of a vectorised operator holds at once. A longer
#: document is a step of its own.
PART_BYTES = 1 << 19

_ODD = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, columns: tuple[str, ...]) -> str:
    """The schema string of columns that an operator passes through, after its own."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return "".join(f", `{c}` {kinds[c]}" for c in columns)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on, and what one operator took would count beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_parts(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i..j of a string column with their offsets (from 0) and UTF-8 bytes, about limit bytes a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, off[i : j + 1] - off[i], raw[off[i] : off[j]]
        i = j


def byte_class(pattern_bytes: bytes | range) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[np.frombuffer(bytes(pattern_bytes), np.uint8)] = True
    return lut


#: Words between ASCII white space, as in [^\x20\x09-\x0D]+.
SPACED = ~byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross rows, and each row's first run (one more entry than rows)."""
    n = len(mask)
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, from one pass over data."""
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def text_hash(word: str) -> int:
    """span_hashes of one word, as a Python int."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of size consecutive words that don't cross rows, and the index of each one's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= np.uint64(_ODD)
        h += words[k : k + n]
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= row_end)
    return mixed(h[at]), at
