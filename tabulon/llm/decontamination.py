"""Operator 8: benchmark passages in documents, by SimHash of item-sized windows."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_parts, carried, forget, release, shingle_hashes, span_hashes, spans, table, written
from .licenses import WORD

SHINGLE, SIMILARITY = 5, 0.8
#: Windows within this many of 64 bits of an item are found by the blocks of the fingerprint. At a similarity of
#: 0.8 about 10 bits differ; unrelated windows differ in 32.
RADIUS = 11
#: Places where a fingerprint is cut. Within RADIUS bits, one of the blocks differs in RADIUS // 6 bits (1) at most.
CUTS = (0, 11, 22, 33, 44, 54, 64)
#: Bytes of benchmark text that are sent to every executor at once; more goes in several blocks.
ITEM_BYTES = 16 << 20


@dataclass
class Items:
    """A block of the benchmark, indexed: shingles to items, and for each window size the items' fingerprints by block."""

    shingles: np.ndarray  # sorted hashes
    owners: list[list[int]]
    seen: np.ndarray  # a bitmap of the hashes' leading bits
    counts: list[Counter]
    size: list[int]  # words of each item
    ids: list[int]
    tables: dict[int, list[dict[int, list[int]]]]
    prints: np.ndarray
    short: dict[int, dict[int, list[int]]]  # items of fewer words than a shingle: by number of words, hash


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, first = spans(WORD[data], offsets)
    return span_hashes(data, starts, ends), first


def blocks_of(fp: int) -> list[int]:
    return [fp >> a & (1 << b - a) - 1 for a, b in pairwise(CUTS)]


def ball(value: int, bits: int, radius: int) -> list[int]:
    """All values of so many bits that differ from value in radius bits or fewer."""
    return [value ^ sum(1 << k for k in flips) for n in range(radius + 1) for flips in combinations(range(bits), n)]


def signs(h: np.ndarray) -> np.ndarray:
    """1 for each bit that is set, else -1."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def prints_of(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def index(items: list[tuple[int, str]]) -> Items:
    owners: dict[int, list[int]] = {}
    counts, size, ids, prints = [], [], [], []
    short: dict[int, dict[int, list[int]]] = {}
    tables: dict[int, list[dict[int, list[int]]]] = {}
    widths = [b - a for a, b in pairwise(CUTS)]
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        words, first = words_of(raw, np.array([0, len(raw)]))
        if len(words) < SHINGLE:
            if len(words):
                h, _ = shingle_hashes(words, first, len(words))
                short.setdefault(len(words), {}).setdefault(int(h[0]), []).append(item)
            continue
        h, _ = shingle_hashes(words, first, SHINGLE)
        k = len(ids)
        ids.append(item), size.append(len(words)), counts.append(Counter(h.tolist()))
        fp = int(prints_of(signs(h).sum(axis=0, keepdims=True))[0])
        prints.append(fp)
        for x in counts[k]:
            owners.setdefault(x, []).append(k)
        for known, value, width in zip(tables.setdefault(len(words), [{} for _ in widths]), blocks_of(fp), widths, strict=True):
            for v in ball(value, width, RADIUS // len(widths)):
                known.setdefault(v, []).append(k)
    keys = np.array(sorted(owners), np.uint64)
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> np.uint64(44)).astype(np.int64)] = True
    return Items(keys, [owners[int(x)] for x in keys], seen, counts, size, ids, tables, np.array(prints, np.uint64), short)


def similarity(a: Counter, b: Counter) -> float:
    """Shared shingles over all of both, each weighing as often as it stands there."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def matches(ix: Items, shingles: np.ndarray, hits: np.ndarray, found: np.ndarray, n_words: int, beyond: bool = True) -> dict[int, tuple[float, int, int]]:
    """Of one island of a row: item to (similarity, first word, words) of its best window. hits: places of shingles that items have, found: which.

    A window that shares a shingle with an item of its size is fingerprinted,
    and looked up in the blocks: items within the radius are verified. Only what
    the blocks haven't named goes the other way (if beyond): an item further off
    is verified where a window has as many of its shingles as the similarity
    takes. A window with fewer can't reach it, so nothing is lost."""
    best: dict[int, tuple[float, int, int]] = {}
    by_size: dict[int, dict[int, list[int]]] = {}
    for p, f in zip(hits.tolist(), found.tolist(), strict=True):
        for k in ix.owners[f]:
            by_size.setdefault(ix.size[k], {}).setdefault(k, []).append(p)
    for size, by_item in by_size.items():
        m = min(size, n_words) - SHINGLE + 1  # shingles of a window; a shorter row is one window
        needed = int(np.ceil(SIMILARITY * (m + size - SHINGLE + 1) / (1 + SIMILARITY) - 1e-9))
        p = np.array(sorted({x for own in by_item.values() for x in own}), np.int64)
        for group in np.split(p, np.flatnonzero(np.diff(p) > 2 * m) + 1):
            a, b = max(0, int(group[0]) - m + 1), min(len(shingles), int(group[-1]) + m)
            if b - a < m:
                continue
            total = np.zeros((b - a + 1, 64), np.int32)
            np.cumsum(signs(shingles[a:b]), axis=0, out=total[1:])
            shared = np.zeros(b - a + 1, np.int64)
            shared[group - a + 1] = 1
            shared = np.cumsum(shared)
            some = np.flatnonzero(shared[m:] - shared[:-m] > 0)
            prints = prints_of(total[some + m] - total[some])
            near = {(w, k) for w, fp in zip((some + a).tolist(), prints.tolist(), strict=True) for known, v in zip(ix.tables[size], blocks_of(fp), strict=True) for k in known.get(v, ()) if (fp ^ int(ix.prints[k])).bit_count() <= RADIUS}
            rest = set()
            for k, own in by_item.items() if beyond else ():
                if len(own) >= needed:
                    own = np.array(own)
                    enough = np.searchsorted(own, some + a + m) - np.searchsorted(own, some + a) >= needed
                    rest |= {(w, k) for w in (some[enough] + a).tolist()} - near
            for w, k in near | rest:
                s = similarity(Counter(shingles[w : w + m].tolist()), ix.counts[k])
                if s >= SIMILARITY and (s, -w) > (best.get(k, (0, 0, 0))[0], -best.get(k, (0, 0, 0))[1]):
                    best[k] = (s, w, m + SHINGLE - 1)
    return {ix.ids[k]: v for k, v in best.items()}


@dataclass
class Sieve:
    """What of the benchmark all tasks know: which leading bits its runs of words have, the lengths of items that are shorter than a shingle, the longest item."""

    bits: int
    words: np.ndarray
    short: list[int]
    longest: int

    def may_be(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes that some item may have."""
        at = h >> np.uint64(64 - self.bits)
        return np.flatnonzero(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))


def sieve(items: DataFrame) -> Sieve:
    """items: item, text. Bits are set in tasks and merge as sums do; there are about 16 of them for each shingle, 2^30 at most."""
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    bits = min(30, max(16, int(size * 4).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in byte_parts(batch.column(1)):
                words, first = words_of(data, offsets)
                sizes = np.diff(first)
                for n in (*range(1, SHINGLE), SHINGLE):
                    h, at = shingle_hashes(words, first, n)
                    row = np.searchsorted(first, at, "right") - 1
                    h = h[(sizes[row] == n) | (n == SHINGLE)]
                    place = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), n)), pa.array(place), pa.array(np.full(len(place), sizes.max(initial=0)))], ["n", "place", "longest"])

    marks = written(items.select("item", "text").mapInArrow(marked, "n long, place long, longest long"), "marks")
    facts = marks.agg(F.collect_set(F.when(F.col("n") < SHINGLE, F.col("n"))).alias("short"), F.max("longest").alias("longest")).first()
    found = marks.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    forget(marks)
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Sieve(bits, words, sorted(facts.short), facts.longest or 0)


def islands(words: np.ndarray, first: np.ndarray, known: Sieve) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """(row, places, words) of rows that have a run of words which an item may have: the words around each run, as far as an item that has it can reach. Islands of a row don't touch."""
    found = []
    for n in (*known.short, SHINGLE):
        h, at = shingle_hashes(words, first, n)
        found.append(at[known.may_be(h)])
    p = np.unique(np.concatenate(found))
    if not len(p):
        return
    rows = np.searchsorted(first, p, "right") - 1
    low, high = np.maximum(p - known.longest, first[rows]), np.minimum(p + known.longest + SHINGLE, first[rows + 1])
    apart = np.ones(len(p), bool)
    apart[1:] = (low[1:] > high[:-1]) | (rows[1:] != rows[:-1])
    begins = np.flatnonzero(apart)
    ends = np.append(begins[1:], len(p)) - 1
    by_row: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        at, own = by_row.setdefault(int(rows[a]), ([], []))
        at.append(int(low[a] - first[rows[a]]))
        own.append(words[low[a] : high[b]])
    for r, (at, own) in by_row.items():
        yield r, at, own


def found_in(ix: Items, n_words: int, places: list[int], parts: list[np.ndarray], beyond: bool = True) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of each item that a row's islands match."""
    best: dict[int, tuple[float, int, int]] = {}
    for place, words in zip(places, parts, strict=True):
        first = np.array([0, len(words)])
        for n, known in ix.short.items():
            h, at = shingle_hashes(words, first, n)
            for k in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))).tolist():
                for item in known[int(h[k])]:
                    best.setdefault(item, (1.0, place + int(at[k]), n))
        h, _ = shingle_hashes(words, first, SHINGLE)
        if not len(h) or not len(ix.shingles):
            continue
        maybe = np.flatnonzero(ix.seen[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(ix.shingles, h[maybe]), len(ix.shingles) - 1)
        sure = ix.shingles[k] == h[maybe]
        for item, (s, w, n) in matches(ix, h, maybe[sure], k[sure], n_words, beyond).items():
            if s > best.get(item, (0.0, 0, 0))[0]:  # islands come in the order of the row
                best[item] = (s, place + w, n)
    for item, (s, w, n) in best.items():
        yield item, s, w, n


#: The block that this worker has indexed last.
_LAST: dict[str, Items] = {}


def indexed(name: str, shared: Broadcast) -> Items:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = index(shared.value)
    return _LAST[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), beyond: bool = True) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: one row for each document row and item that a window of it resembles, with the best window, the first of equal ones.

    Documents are read once, whatever the benchmark's size, and aren't shuffled:
    where they have a run of words that an item may have, the words around it
    are an island, and islands are all that is compared. Items of fewer than
    SHINGLE words match where all their words stand; null and empty items never.
    Null and empty documents match nothing; a null doc_id stays null, and
    repeated rows match as often as they occur. carry: columns of docs that come
    with each match. The benchmark goes to the executors in blocks of bounded
    size; a worker indexes a block once. More than one block has islands written
    to a table, which each block reads. beyond: see matches()."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    context = docs.sparkSession.sparkContext
    shaped = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    known = context.broadcast(sieve(items))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in byte_parts(batch.column(1)):
                words, first = words_of(data, offsets)
                rows = list(islands(words, first, known.value))
                if rows:
                    at, places, parts = zip(*rows, strict=True)
                    own = batch.slice(i, j - i).take(pa.array(at, pa.int64()))
                    n = pa.array([int(first[r + 1] - first[r]) for r in at], pa.int64())
                    yield pa.RecordBatch.from_arrays([own.column(0), n, pa.array(places, pa.list_(pa.int64())), pa.array([[w.view(np.int64) for w in p] for p in parts], pa.list_(pa.list_(pa.int64()))), *own.columns[2:]], ["doc_id", "n_words", "places", "parts", *carry])
        release()

    near = shaped.mapInArrow(cut, "doc_id long, n_words long, places array<long>, parts array<array<long>>" + carried(docs, carry))
    if blocks > 1:
        near = written(near, "islands")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    names = [*(f.split()[0] for f in schema.split(", ")), *carry]
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        shared = context.broadcast([(r.item, r.text) for r in part])

        def scan(batches: Iterator[pa.RecordBatch], name=uuid.uuid4().hex, shared=shared) -> Iterator[pa.RecordBatch]:
            ix = indexed(name, shared)
            for batch in batches:
                found = []
                for r in range(batch.num_rows):
                    parts = [p.values.to_numpy().view(np.uint64) for p in batch.column(3)[r]]
                    found += [(r, *x) for x in found_in(ix, batch.column(1)[r].as_py(), batch.column(2)[r].as_py(), parts, beyond)]
                if found:
                    at, *rest = zip(*found, strict=True)
                    own = batch.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, pa.float64() if k == 1 else pa.int64()) for k, c in enumerate(rest)), *own.columns[4:]], names)

        found = near.mapInArrow(scan, schema + carried(docs, carry))
        out = found if out is None else out.union(found)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated() of all documents by all benchmark items; empty tables give no rows."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
