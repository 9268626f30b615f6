"""Operator 2: SimHash near-duplicates by a range join in the space of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, release, spread_join, table, written
from .components import components

#: The fingerprint's segments have SEGMENT bits; groups of segments are the sides of a grid cell.
SEGMENT = 2
#: Groups of segments for so many distinct fingerprints: more make smaller cells, and more of them. Any number is exact.
FINER = ((1 << 26, 6), (1 << 32, 8), (1 << 40, 10))
#: Members of a cell that are compared at once; a larger cell is divided further.
CELL = 2048


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed long), and the columns to carry; null and empty texts have 0.

    Shingles count as often as they occur; the last of a text's words that are
    too few for one make one shingle. Rows keep their partition."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for r, value in enumerate(batch.column(1)):
                words = (value.as_py() or "").encode().lower().split()
                if not words:
                    continue
                joined = b" ".join(words)
                if len(words) <= size:
                    out[r] = digest(joined, 42)
                    continue
                n = len(words) - size + 1
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.concatenate([[0], ends[: n - 1]]).tolist()
                stops = (ends[size - 1 :] - 1).tolist()
                h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
                count = np.zeros(64, np.int64)
                for k in range(0, n, 4096):
                    count += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                out[r] = np.packbits(count * 2 > n).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(hashed, "doc_id long, fp long" + carried(docs, carry))


def bit_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bits set in each segment, one row per fingerprint."""
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(fp), 64 // SEGMENT, SEGMENT).sum(axis=2, dtype=np.uint8)


def _sides(radius: int, groups: int) -> list[np.ndarray]:
    return np.array_split(np.arange(64 // SEGMENT), max(groups, radius + 1))


def _divided(v: np.ndarray, radius: int, segments: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of a cell (rows of v) and the segments that may still differ in them. Any two rows within the radius meet in a part: of radius + 1 lots of segments they agree in one."""
    for lot in np.array_split(segments, radius + 1):
        key = np.ascontiguousarray(v[:, lot]).view(f"V{len(lot) * v.itemsize}").ravel() if len(lot) else np.zeros(len(v), "V1")
        _, which = np.unique(key, return_inverse=True)
        order = np.argsort(which, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            if len(part) > 1:
                yield part, np.setdiff1d(segments, lot)


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the links that join what those before them don't."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def forest(fp: np.ndarray, node: np.ndarray, radius: int, segments: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what is linked within one cell, fewer than it has members.

    Each member that is reached looks once for members not reached yet: by
    Manhattan distance of the bit counts, a lower bound, then by the bits. A
    cell of many members is first divided by segments that its members differ
    in, and again as long as that makes parts smaller."""
    v, left, out = bit_counts(fp).astype(np.int16), np.arange(len(fp)), []
    if len(fp) > CELL:
        segments = np.flatnonzero(v.min(axis=0) < v.max(axis=0)) if segments is None else segments
        if len(segments) > radius:
            for part, rest in _divided(v, radius, segments):
                out += forest(fp[part], node[part], radius, rest)
            return spanning(out)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = left[np.abs(v[left] - v[k]).sum(axis=1) <= radius]
            near = near[np.bitwise_count(fp[near] ^ fp[k]) <= radius]
            if len(near):
                out += [(int(node[k]), int(node[x])) for x in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return out


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """prints: node, fp, distinct fp. Links (a, b) between nodes whose fingerprints differ in radius bits or fewer, enough of them to connect all that are connected.

    The grid: a fingerprint's bit counts, in groups of segments. Two that lie
    within Manhattan distance radius agree in all but radius groups, so each
    goes to a cell for every choice of that many groups; one link at least of
    any two that are near stands in each cell they share. With 6 groups a cell's
    key has about 24 bits, with 8 about 30, with 10 about 33."""
    n = prints.count()
    sides = _sides(radius, next((g for most, g in FINER if n <= most), FINER[-1][1]))
    choices = list(combinations(range(len(sides)), len(sides) - radius))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                fp = part.column(1).to_numpy().view(np.uint64)
                v = bit_counts(fp).astype(np.uint64)
                side = [sum((v[:, s] << np.uint64(2 * i) for i, s in enumerate(group)), np.zeros(len(fp), np.uint64)) for group in sides]
                for c, chosen in enumerate(choices):
                    cell = np.full(len(fp), c, np.uint64)
                    for g in chosen:
                        cell = (cell << np.uint64(2 * len(sides[g]))) | side[g] if 2 * sum(len(sides[x]) for x in chosen) <= 58 else cell * np.uint64(0x9E3779B97F4A7C15) + side[g]
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), part.column(0), part.column(1)], ["cell", "node", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by cell; what is held is one cell's fingerprints
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = None

        def close() -> list[tuple[int, int]]:
            node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            return forest(fp.view(np.uint64), node, radius) if len(fp) > 1 else []

        for batch in batches:
            cell, node, fp = (batch.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and cell[a] != at:
                    out += close()
                    held = []
                at = cell[a]
                held.append((node[a:b], fp[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        if held:
            out = close()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        held.clear()
        release()

    cells = prints.select("node", "fp").mapInArrow(celled, "cell long, node long, fp long")
    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable), group (the component's smallest fingerprint as a signed long), and the columns to carry.

    Equal fingerprints meet in one row before anything is compared, so a group
    of copies, whatever its size, is one member of a cell. Links are between
    fingerprints, so rows with a null doc_id join groups too; component_id is
    null where no row of the group has a doc_id. Rows with one doc_id and
    different texts are rows of their own; repeated rows come back as often."""
    prints = written(fingerprints(docs, id_col, text_col, carry=carry), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(near_links(classes.select(F.col("fp").alias("node"), "fp"), radius)).withColumnRenamed("node", "fp")
    # a fingerprint without links is a component of its own; only the others are gathered
    joined = written(classes.join(linked, "fp"), "linked")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    named = spread_join(joined, least, ["component"]).select("fp", F.col("component").alias("group"), "least")
    named = written(classes.join(named, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), F.when(F.col("group").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "named")
    # a fingerprint that very many rows have meets them where they are
    return spread_join(prints, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", *carry)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents; null and empty texts have fingerprint zero and one group."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("group")
