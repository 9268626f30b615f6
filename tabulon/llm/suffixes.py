"""Operator 9: removal of repeated byte strings by a distributed, sparse suffix array.

A string of LEAST bytes holds a k-mer of smallest hash; where it stands in the
string depends on the string alone, so equal strings in two documents have it
at the same place. Only the suffixes that start at such k-mers (anchors) enter
the suffix array, about one of 18. All strings around an anchor are decided
there: an anchor's context is what any of them can reach.

Three passes over groups of documents (a group is a hash of doc_id, some MB):
1. each group sends the hashes of its anchors' k-mers to the bucket of their
   leading bytes; a bucket answers which stand in several documents;
2. suffixes at those anchors go, each distinct context once for a group, to the
   bucket of their leading bytes, between splitters from a sample. A bucket
   sorts them by multikey quicksort and finds, for each of the strings around
   an anchor, the smallest document. The k-mer is longer than what splitters
   compare, so equal strings never fall on both sides of a border;
3. each group takes the answers and cuts the bytes.
A k-mer that more than HOT_GROUPS groups have (a passage of a third of all
documents) could bring a bucket more contexts than it can hold. Its strings go
one by one instead, each distinct one once for a group, to buckets by their
hash: as many rows as groups at most share a string, whatever stands around it.
What a group sends to a bucket is one row of many keys, and buckets answer only
where a key is shared, so rows never outnumber keys, however many buckets are.
A document's text is shuffled once, by group; that exchange serves all passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_parts, carried, mixed, release, spans, table

LEAST = 50
KMER = 16
#: Bytes of text in a group of documents, and in the sample that splitters come from.
GROUP_BYTES, SAMPLE_BYTES = 6 << 20, 16 << 20
#: Splitters at most. Where the input needs more buckets, each range between two of them is dealt to several by the hash of the k-mer.
SPLITTERS = 1023
#: Groups that may share a k-mer before its strings are dealt out one by one.
HOT_GROUPS = 512
SIDE = LEAST - KMER  # how far strings around an anchor reach to either side of its k-mer
WIDTH = KMER + 2 * SIDE
_SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Buckets:
    """Where suffixes go: by their leading bytes to a range, in it by the hash of their k-mer to one of its parts."""

    splitters: np.ndarray
    parts: int

    @property
    def n(self) -> int:
        return (len(self.splitters) + 1) * self.parts

    def of(self, lead: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.splitters, lead, "right") * self.parts + ((h >> np.uint64(20)) % np.uint64(self.parts)).astype(np.int64)


@dataclass
class Anchors:
    at: np.ndarray  # places in the part's bytes
    row: np.ndarray
    lead: np.ndarray  # the first 8 bytes, as a number
    hash: np.ndarray


def _slide(h: np.ndarray, width: int, least) -> np.ndarray:
    """least (minimum or maximum) of each width neighbours, by doubling."""
    n, size = len(h) - width + 1, 1
    while 2 * size <= width:
        h = least(h[:-size], h[size:])
        size *= 2
    return least(h[:n], h[width - size : width - size + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    """The k-mers of smallest hash in any LEAST bytes of a row; all of equal ones."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < LEAST:
        return Anchors(none, none, none.astype(np.uint64), none.astype(np.uint64))
    raw = np.ascontiguousarray(data)
    words = np.ndarray((n - 7,), ">u8", raw, 0, (1,)).astype(np.uint64)
    h = mixed(words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93))
    width = LEAST - KMER + 1
    low = _slide(h, width, np.minimum)  # for the string that starts at each byte
    inside = np.ones(len(low) + 1, np.int32)  # off where the string would leave its row
    size = np.diff(offsets)
    ends = offsets[1:]
    first_off = np.maximum(ends - LEAST + 1, offsets[:-1])
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first_off[size > 0], 1)
    np.add.at(step, ends[size > 0], -1)
    inside = np.cumsum(step[: len(low)]) == 0
    low = np.where(inside, low, 0)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    top = _slide(padded, width, np.maximum)[: len(h)]  # over the strings that hold the k-mer at each byte
    at = np.flatnonzero((top == h) & (top > 0))
    return Anchors(at, np.searchsorted(offsets, at, "right") - 1, words[at], h[at])


def ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])


@dataclass
class Part:
    first: int
    offsets: np.ndarray
    data: np.ndarray
    found: Anchors
    docs: np.ndarray


def parts(group: pa.Table) -> list[Part]:
    docs = group.column("doc_id").to_numpy()
    return [Part(i, offsets, data, anchors(data, offsets), docs[i:j]) for i, j, offsets, data in byte_parts(group.column("text"))]


def keys(group: list[Part], to: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, k-mer hash) of a group, in order, and if they stand in several of its documents."""
    pieces = [(to.of(p.found.lead, p.found.hash), p.found.hash, p.docs[p.found.row]) for p in group]
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    bucket, h, doc = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.lexsort((doc, h, bucket))
    bucket, h, doc = bucket[order], h[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])])) if len(h) else np.empty(0, np.int64)
    last = np.append(head[1:], len(h)) - 1 if len(h) else head
    return bucket[head], h[head], doc[head] != doc[last]


def _blobs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    if not len(bucket):
        return
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def contexts(part: Part, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """What strings around the anchors can reach, suffix first: WIDTH bytes (0 beyond the row), then how far to the left and right; padded to words."""
    start, end = part.offsets[row], part.offsets[row + 1]
    left, right = np.minimum(SIDE, at - start), np.minimum(SIDE, end - at - KMER)
    out = np.zeros((len(at), -(-(WIDTH + 2) // 8) * 8), np.uint8)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), part.data, np.zeros(SIDE, np.uint8)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    column = np.arange(WIDTH)
    seen = np.where((column >= SIDE - left[:, None]) & (column < SIDE + KMER + right[:, None]), seen, 0)
    out[:, : KMER + SIDE] = seen[:, SIDE:]
    out[:, KMER + SIDE : WIDTH] = seen[:, :SIDE]
    out[:, WIDTH], out[:, WIDTH + 1] = left, right
    return out


@dataclass
class Suffixes:
    """A group's suffixes at shared anchors: distinct contexts by bucket, each one's smallest document, and where each anchor's context is."""

    bucket: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    which: list[np.ndarray]
    places: list[tuple[Part, np.ndarray, np.ndarray]]
    windows: Windows


@dataclass
class Windows:
    """A group's distinct strings around k-mers that are everywhere: bytes padded to words, each one's smallest document, and for each part where which starts."""

    bucket: np.ndarray
    text: np.ndarray
    doc: np.ndarray
    which: list[np.ndarray]
    starts: list[tuple[np.ndarray, np.ndarray]]


def row_hash(rows: np.ndarray) -> np.ndarray:
    words = rows.view("<u8")
    factor = mixed(np.arange(1, words.shape[1] + 1, dtype=np.uint64))
    return mixed((mixed(words ^ factor) * (factor | np.uint64(1))).sum(axis=1, dtype=np.uint64))


def distinct(rows: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct row, by bucket, with its smallest document first; and which of them each row is."""
    order = np.lexsort((doc, row_hash(rows), bucket))
    rows = rows[order]
    # equal hashes with other bytes stay apart; then a row may stand twice, which its bucket sorts out
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[np.flatnonzero(new)], which


def _chosen(h: np.ndarray, kept: list[np.ndarray]) -> np.ndarray:
    wanted = np.sort(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
    if not len(wanted):
        return np.zeros(len(h), bool)
    return wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h


def windows(found: list[tuple[Part, np.ndarray, np.ndarray]], n: int) -> Windows:
    """All strings of LEAST bytes that hold the anchors found, none beyond its row."""
    starts, texts, docs = [], [], []
    for p, at, row in found:
        first = np.maximum(at - SIDE, p.offsets[row])
        count = np.maximum(np.minimum(at, p.offsets[row + 1] - LEAST) - first + 1, 0)
        s = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        s, keep = np.unique(s, return_index=True)
        r = np.repeat(row, count)[keep]
        starts.append((s, r))
        text = np.zeros((len(s), 56), np.uint8)
        if len(s):
            text[:, :LEAST] = np.lib.stride_tricks.sliding_window_view(p.data, LEAST)[s]
        texts.append(text)
        docs.append(p.docs[r])
    empty = np.empty(0, np.int64)
    if not sum(map(len, texts)):
        return Windows(empty, np.empty((0, 56), np.uint8), empty, [empty for _ in found], starts)
    text, doc = np.concatenate(texts), np.concatenate(docs)
    bucket = n + (row_hash(text) % np.uint64(n)).astype(np.int64)
    head, which = distinct(text, doc, bucket)
    return Windows(bucket[head], text[head], doc[head], np.split(which, np.cumsum([len(x) for x in texts])[:-1]), starts)


def suffixes(group: list[Part], to: Buckets, shared: dict[int, np.ndarray], hot: dict[int, np.ndarray]) -> Suffixes:
    """shared and hot: for each bucket, which of the group's keys there stand in several documents, and in very many groups."""
    bucket, h, _ = keys(group, to)
    one_by_one = [h[s][hot[b][: s.stop - s.start]] for b, s in _blobs(bucket) if b in hot]
    together = [h[s][(shared[b] & ~hot.get(b, np.zeros_like(shared[b])))[: s.stop - s.start]] for b, s in _blobs(bucket) if b in shared]
    places, rows, docs, at_buckets, everywhere = [], [], [], [], []
    for p in group:
        hit = _chosen(p.found.hash, together)
        at, row = p.found.at[hit], p.found.row[hit]
        places.append((p, at, row))
        rows.append(contexts(p, at, row))
        docs.append(p.docs[row])
        at_buckets.append(to.of(p.found.lead[hit], p.found.hash[hit]))
        hit = _chosen(p.found.hash, one_by_one)
        everywhere.append((p, p.found.at[hit], p.found.row[hit]))
    single = windows(everywhere, to.n)
    if not sum(map(len, rows)):
        empty = np.empty(0, np.int64)
        return Suffixes(empty, np.empty((0, -(-(WIDTH + 2) // 8) * 8), np.uint8), empty, [empty for _ in places], places, single)
    context, doc = np.concatenate(rows), np.concatenate(docs)
    at_bucket = np.concatenate(at_buckets)
    head, which = distinct(context, doc, at_bucket)
    return Suffixes(at_bucket[head], context[head], doc[head], np.split(which, np.cumsum([len(x) for x in rows])[:-1]), places, single)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words (big-endian numbers), column by column: after each, only rows still tied are sorted by the next. Also the first column in which each row differs from the one before (the number of columns: in none)."""
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    differs = np.full(n, width, np.int64)
    value = words[order, 0]
    differs[0] = 0
    differs[1:][value[1:] != value[:-1]] = 0
    for c in range(1, width):
        tied = differs == width
        member = tied.copy()
        member[:-1] |= tied[1:]
        rows = np.flatnonzero(member)
        if not len(rows):
            break
        run = np.cumsum(~tied[rows])
        inner = np.lexsort((words[order[rows], c], run))
        order[rows] = order[rows][inner]
        value = words[order[rows], c]
        odd = np.flatnonzero((value[1:] != value[:-1]) & (run[1:] == run[:-1])) + 1
        differs[rows[odd]] = c
    return order, differs


def repeated(context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix of a bucket, bits of the strings (SIDE + 1 of them, by how far left of the anchor they start) that a smaller document has too."""
    n = len(context)
    mask = np.zeros(n, np.uint64)
    if not n:
        return mask
    words = np.ascontiguousarray(context).view(">u8").astype(np.uint64)
    order, differs = multikey_order(words)
    context, doc = context[order], doc[order]
    new = differs < words.shape[1]
    head = np.flatnonzero(new)
    cls = np.cumsum(new) - 1  # classes of equal contexts
    least = np.minimum.reduceat(doc, head)
    left, right = context[head, WIDTH].astype(np.int64), context[head, WIDTH + 1].astype(np.int64)
    kmer = np.cumsum(differs[head] < KMER // 8) - 1
    some = np.flatnonzero(np.bincount(kmer)[kmer] > 1)  # the others have the strings of one context only
    text = np.concatenate([context[head[some], KMER + SIDE : WIDTH], context[head[some], : KMER + SIDE]], axis=1)
    for o in range(SIDE + 1):
        valid = (o <= left) & (SIDE - o <= right)
        best = least
        here = np.flatnonzero(valid[some])
        if len(here) > 1:
            window = np.zeros((len(here), 56), np.uint8)
            window[:, :LEAST] = text[here, SIDE - o : SIDE - o + LEAST]
            hashed = row_hash(window)
            by = np.argsort(hashed, kind="stable")
            sorted_ = window[by]
            if not _clean(hashed[by], sorted_):  # two strings with one hash: sort by the bytes
                by, _ = multikey_order(window.view(">u8").astype(np.uint64))
                sorted_ = window[by]
            first = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]))
            low = np.minimum.reduceat(least[some[here[by]]], first)
            best = least.copy()
            best[some[here[by]]] = np.repeat(low, np.diff(np.append(first, len(by))))
        mask |= np.where(valid[cls] & (best[cls] < doc), np.uint64(1 << o), np.uint64(0))
    out = np.empty(n, np.uint64)
    out[order] = mask
    return out


def beaten(text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 for each string that a smaller document has too, else 0."""
    by, differs = multikey_order(text.view(">u8").astype(np.uint64))
    head = np.flatnonzero(differs < text.shape[1] // 8)
    least = np.repeat(np.minimum.reduceat(doc[by], head), np.diff(np.append(head, len(by))))
    out = np.empty(len(doc), np.uint64)
    out[by] = least < doc[by]
    return out


def _clean(h: np.ndarray, rows: np.ndarray) -> bool:
    return not ((h[1:] == h[:-1]) & (rows[1:] != rows[:-1]).any(axis=1)).any()


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def lean(f: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """f for each group, its memory given back before the next one."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = f(key, group)
        release()
        return out

    return run


def lean2(f: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        out = f(key, group, answers)
        release()
        return out

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, if asked for kept (what is left, as bytes), and the columns to carry.

    A byte goes if a string of LEAST bytes that covers it also starts in a
    document with a smaller doc_id. Null texts are empty. Rows with one doc_id
    are one document: they don't cut each other, and are dealt out one by one.
    A null doc_id counts as the smallest number there is."""
    spark = docs.sparkSession
    clean = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("own"), *(F.col(c).alias(f"_{c}") for c in carry))
    total = clean.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    groups = max(1, -(-total // GROUP_BYTES))
    every = max(1, total // SAMPLE_BYTES)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in byte_parts(batch.column(0)):
                found = (anchors(data, offsets).lead ^ _SIGN).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["lead"])

    if groups > 1:
        sample = clean.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(every)) == 0).select("text").mapInArrow(leads, "lead long")
        ranges = min(groups, SPLITTERS + 1)
        at = sample.agg(F.percentile_approx("lead", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
        splitters = np.unique(np.array(at, np.int64).view(np.uint64) ^ _SIGN)
    else:
        splitters = np.empty(0, np.uint64)
    to = Buckets(splitters, -(-groups // (len(splitters) + 1)))

    # rows of one doc_id go apart, as it may be null in very many
    grouped = clean.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), "*").repartition(groups, "g")

    def send_keys(key: tuple, group: pa.Table) -> pa.Table:
        bucket, h, many = keys(parts(ordered(group)), to)
        blobs = [(b, h[s].tobytes(), np.packbits(many[s]).tobytes()) for b, s in _blobs(bucket)]
        return pa.table({"bucket": pa.array([x[0] for x in blobs], pa.int64()), "g": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "hashes": pa.array([x[1] for x in blobs], pa.binary()), "many": pa.array([x[2] for x in blobs], pa.binary())})

    def answer_keys(key: tuple, group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(h)) for m, h in zip(group.column("many"), lists, strict=True)]).astype(bool)
        h = np.concatenate(lists)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        shared = np.zeros(len(h), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        shared |= many
        # a group has a key once, so a run of equal hashes is as long as the groups that have it
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        times = np.diff(np.append(head, len(h)))
        hot = np.empty(len(h), bool)
        hot[order] = np.repeat(times > HOT_GROUPS, times)
        cut = np.cumsum([0, *map(len, lists)])
        out = []
        for g, b, i, j in zip(group.column("g").to_pylist(), group.column("bucket").to_pylist(), cut[:-1], cut[1:], strict=True):
            if shared[i:j].any():  # most keys are one group's, and need no answer
                out.append((g, b, 0, np.packbits(shared[i:j]).tobytes()))
            if hot[i:j].any():
                out.append((g, b, 2, np.packbits(hot[i:j]).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["g", "bucket", "kind", "data"])

    def taken(answers: pa.Table, kind: int) -> dict[int, bytes]:
        chosen = answers.filter(pc.equal(answers.column("kind"), kind))
        return dict(zip(chosen.column("bucket").to_pylist(), chosen.column("data").to_pylist(), strict=True))

    def as_bits(x: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool)

    def found(answers: pa.Table) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        return tuple({b: as_bits(x) for b, x in taken(answers, kind).items()} for kind in (0, 2))

    def send_suffixes(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        s = suffixes(parts(ordered(group)), to, *found(answers))
        blobs = [(b, _pack(s.context[x]), _pack(s.doc[x])) for b, x in _blobs(s.bucket)]
        blobs += [(b, _pack(s.windows.text[x]), _pack(s.windows.doc[x])) for b, x in _blobs(s.windows.bucket)]
        g = key[0].as_py()
        return pa.table({"bucket": pa.array([x[0] for x in blobs], pa.int64()), "g": pa.array([g] * len(blobs), pa.int64()), "contexts": pa.array([x[1] for x in blobs], pa.binary()), "docs": pa.array([x[2] for x in blobs], pa.binary())})

    def answer_suffixes(key: tuple, group: pa.Table) -> pa.Table:
        doc = [_unpack(x.as_py(), np.int64) for x in group.column("docs")]
        context = np.concatenate([_unpack(x.as_py(), np.uint8) for x in group.column("contexts")]).reshape(sum(map(len, doc)), -1)
        mask = (repeated if key[0].as_py() < to.n else beaten)(context, np.concatenate(doc))
        cut = np.cumsum([0, *map(len, doc)])
        return pa.table({"g": group.column("g"), "bucket": group.column("bucket"), "kind": pa.array([1] * len(doc), pa.int32()), "data": pa.array([_pack(mask[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def cut(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        group = ordered(group)
        s = suffixes(parts(group), to, *found(answers))
        masks = taken(answers, 1)
        lost = np.concatenate([_unpack(masks[b], np.uint64) for b, _ in _blobs(s.windows.bucket)]) > 0 if len(s.windows.bucket) else np.empty(0, bool)
        mask = np.concatenate([_unpack(masks[b], np.uint64) for b, _ in _blobs(s.bucket)]) if len(s.bucket) else np.empty(0, np.uint64)
        left, right = s.context[:, WIDTH].astype(np.int64), s.context[:, WIDTH + 1].astype(np.int64)
        offset = np.arange(SIDE + 1)
        n_removed, n_spans, sha, kept = [], [], [], []
        for (p, at, row), which, (single, own), string in zip(s.places, s.which, s.windows.starts, s.windows.which, strict=True):
            bits = mask[which]
            # a document above the smallest of its context's in this group loses all strings there
            later = p.docs[row] > s.doc[which]
            step = np.zeros(len(p.data) + LEAST + 1, np.int64)
            odd = np.flatnonzero(later | (bits > 0))
            for k in range(0, len(odd), 20_000):
                some = odd[k : k + 20_000]
                valid = (offset <= left[which[some]][:, None]) & (SIDE - offset <= right[which[some]][:, None])
                chosen = valid & (later[some][:, None] | ((bits[some][:, None] >> offset.astype(np.uint64)) & np.uint64(1)).astype(bool))
                r, o = np.nonzero(chosen)
                starts = np.bincount(at[some][r] - o, minlength=len(p.data))
                step[: len(starts)] += starts
                step[LEAST : LEAST + len(starts)] -= starts
            single = single[lost[string] | (p.docs[own] > s.windows.doc[string])]
            step[single] += 1  # no start stands twice
            step[single + LEAST] -= 1
            gone = np.cumsum(step[: len(p.data)]) > 0
            _, _, first = spans(gone, p.offsets)
            n_spans += np.diff(first).tolist()
            total = np.concatenate([[0], np.cumsum(gone)])
            n_removed += (total[p.offsets[1:]] - total[p.offsets[:-1]]).tolist()
            for a, b in zip(p.offsets[:-1], p.offsets[1:], strict=True):
                left_over = p.data[a:b][~gone[a:b]].tobytes()
                sha.append(hashlib.sha256(left_over).hexdigest())
                kept.append(left_over if with_text else None)
        out = {"doc_id": group.column("own"), "n_bytes": pc.cast(pc.binary_length(group.column("text")), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}) | {c: group.column(f"_{c}") for c in carry})

    blob = "bucket long, g long, hashes binary, many binary"
    answer = "g long, bucket long, kind int, data binary"
    shared = grouped.groupBy("g").applyInArrow(lean(send_keys), blob).groupBy("bucket").applyInArrow(lean(answer_keys), answer)
    sent = grouped.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(lean2(send_suffixes), "bucket long, g long, contexts binary, docs binary")
    decided = sent.groupBy("bucket").applyInArrow(lean(answer_suffixes), answer)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + carried(docs, carry)
    return grouped.groupBy("g").cogroup(shared.unionByName(decided).groupBy("g")).applyInArrow(lean2(cut), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() of all documents; an empty table gives no rows."""
    return remove_repeats(table(spark, sf_dir, "documents"))
