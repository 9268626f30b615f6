"""Operator 13: ranked lexical search, term at a time over short lists and document at a time over long ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_parts, forget, release, table, written
from .decontamination import words_of

#: Documents of a result.
TOP = 10
#: Postings of a shard: what a task holds of its documents at once. A document is never divided.
SHARD = 1 << 21
#: Lists of at most this share of a shard's documents, or of so many postings, are summed before documents are looked at one after the other.
SHORT_SHARE, SHORT = 64, 64
#: Documents that iterators pass at a time.
STEP = 4096
#: Hashes of query terms in one broadcast, and rows of item terms in another: more of them are sent in several, and each is used on the same scan.
TERMS, ITEM_TERMS = 1 << 20, 1 << 20

_MIX = np.uint64(44)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, key, term, reps: the terms of each distinct item (id and text), as hashes, with how often they stand there."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in byte_parts(batch.column(1)):
                words, first = words_of(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))], ["item_id", "key", "terms"])

    shaped = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    keyed = shaped.withColumn("key", F.concat(F.hex(F.xxhash64("item_id", "text")), F.hex(F.xxhash64("text", F.lit(1)))))
    return keyed.mapInArrow(split, "item_id long, key string, terms array<long>").select("item_id", "key", F.explode("terms").alias("term")).groupBy("item_id", "key", "term").agg(F.count("*").alias("reps"))


def postings(docs: DataFrame, vocabulary: list[Broadcast], id_col: str, text_col: str) -> DataFrame:
    """Per row with a term: doc_id, n (its terms with repeats), terms (of the vocabulary, as hashes), tfs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = []
        for v in (v.value for v in vocabulary):
            seen = np.zeros(1 << 20, bool)
            seen[(v >> _MIX).astype(np.int64)] = True
            known.append((v, seen))
        for batch in batches:
            for i, j, offsets, data in byte_parts(batch.column(1)):
                words, first = words_of(data, offsets)
                rows = np.repeat(np.arange(j - i), np.diff(first))
                wanted = np.zeros(len(words), bool)
                for v, seen in known:
                    maybe = np.flatnonzero(seen[(words >> _MIX).astype(np.int64)])
                    at = np.minimum(np.searchsorted(v, words[maybe]), len(v) - 1)
                    wanted[maybe[v[at] == words[maybe]]] = True
                words, rows = words[wanted], rows[wanted]
                order = np.lexsort((words, rows))
                words, rows = words[order], rows[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(words)))
                lists = pa.array(np.searchsorted(rows[at], np.arange(j - i + 1)).astype(np.int32))
                n = np.diff(first).astype(np.int64)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(lists, pa.array(words[at].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, "doc_id long, n long, terms array<long>, tfs array<long>")


def frequencies(held: DataFrame) -> DataFrame:
    """term, df: the documents that hold it; each task hands on one row a term."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            terms, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            for t, k in zip(terms.tolist(), n.tolist(), strict=True):
                known[t] = known.get(t, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int64()), pa.array(list(known.values()), pa.int64())], ["term", "n"])

    return held.select("terms").mapInArrow(summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


@dataclass
class Lists:
    """Inverted lists of a shard: documents by place (in the order of ids, null last), term by term."""

    ids: np.ndarray
    null: np.ndarray
    terms: np.ndarray  # sorted
    first: np.ndarray  # where each term's list begins
    places: np.ndarray
    impacts: np.ndarray
    most: np.ndarray  # each list's largest impact

    def of(self, term: int) -> tuple[int, int, int] | None:
        k = int(np.searchsorted(self.terms, term))
        return (int(self.first[k]), int(self.first[k + 1]), int(self.most[k])) if k < len(self.terms) and self.terms[k] == term else None


def inverted(rows: list[tuple[np.ndarray, ...]], documents: int, length: int) -> Lists:
    """rows: ids, null, n, terms, tfs and sizes of the shard's batches."""
    ids, null, n, terms, tfs, sizes = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((ids, null))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    at = np.repeat(place, sizes)
    by_term = np.lexsort((at, terms))
    terms, at, tfs = terms[by_term], at[by_term], tfs[by_term]
    m = 25 + 75 * n[order] * documents // length
    impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[at])
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.empty(0, np.int64)
    return Lists(ids[order], null[order], terms[first], np.append(first, len(terms)), at, impacts, np.maximum.reduceat(impacts, first) if len(first) else first)


def summed(places: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places, each once in order, with the sum of their scores."""
    p, s = np.concatenate(places), np.concatenate(scores)
    order = np.argsort(p, kind="stable")
    p, s = p[order], s[order]
    at = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, np.int64)
    return p[at], np.add.reduceat(s, at) if len(p) else s


def best(ix: Lists, terms: np.ndarray, weights: np.ndarray, top: int = TOP, short: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the shard's top documents of one item, best first, equal ones by place.

    Short lists are summed term at a time; the sums are one iterator more, whose
    bound is their largest. All iterators then pass the documents together, a
    step at a time: those whose bounds together can't reach the top are only
    asked about documents that others have named, and steps that can't reach it
    are skipped. Bounds are exact maxima, so nothing is lost."""
    short = max(SHORT, len(ix.ids) // SHORT_SHARE) if short is None else short
    brief, iterators = [], []  # an iterator: bound, places, scores
    for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
        if w > 0 and (found := ix.of(t)):
            a, b, most = found
            if b - a <= short:
                brief.append((ix.places[a:b], w * ix.impacts[a:b]))
            else:
                iterators.append((w * most, ix.places[a:b], w, ix.impacts[a:b]))
    floor = 0  # only scores above it can count
    if brief:
        p, s = summed(*zip(*brief, strict=True))
        iterators.append((int(s.max()), p, 1, s))
        if len(s) >= top:  # whole scores of the best sums are a bound from below
            named = np.sort(p[np.argpartition(-s, top - 1)[:top]])
            floor = int(_whole(iterators, named).min()) - 1
    iterators.sort(key=lambda x: x[0])
    upto = np.cumsum([x[0] for x in iterators])
    kept_p, kept_s = np.empty(0, np.int64), np.empty(0, np.int64)
    if not iterators:
        return kept_p, kept_s
    edges = [np.searchsorted(x[1], np.arange(0, len(ix.ids) + STEP, STEP)) for x in iterators]
    for step in range(-(-len(ix.ids) // STEP)):
        pivot = int(np.searchsorted(upto, floor, "right"))  # the iterators before it can't reach the top by themselves
        if pivot == len(iterators):
            break
        cut = [(x[1][e[step] : e[step + 1]], x[2], x[3][e[step] : e[step + 1]]) for x, e in zip(iterators, edges, strict=True)]
        if all(not len(c[0]) for c in cut[pivot:]):
            continue
        bounds = [int(w * i.max()) if len(i) else 0 for _, w, i in cut]
        if sum(bounds) <= floor:
            continue
        p, s = summed([c[0] for c in cut[pivot:]], [w * i for _, w, i in cut[pivot:]])
        left = sum(bounds[:pivot])
        for k in range(pivot - 1, -1, -1):
            able = s + left > floor
            p, s = p[able], s[able]
            if not len(p):
                break
            s = s + _at(*cut[k], p)
            left -= bounds[k]
        able = s > floor
        kept_p, kept_s = np.concatenate([kept_p, p[able]]), np.concatenate([kept_s, s[able]])
        if len(kept_s) > top:
            order = np.lexsort((kept_p, -kept_s))[:top]
            kept_p, kept_s = kept_p[order], kept_s[order]
        if len(kept_s) == top:  # later documents of an equal score have larger ids
            floor = max(floor, int(kept_s.min()))
    order = np.lexsort((kept_p, -kept_s))
    return kept_p[order], kept_s[order]


def _at(places: np.ndarray, w: int, impacts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """An iterator's scores at wanted places; 0 where it doesn't stop."""
    if not len(places):
        return np.zeros(len(wanted), np.int64)
    k = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return np.where(places[k] == wanted, w * impacts[k], 0)


def _whole(iterators: list[tuple], wanted: np.ndarray) -> np.ndarray:
    return sum(_at(p, w, i, wanted) for _, p, w, i in iterators)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, shard: int = SHARD, short: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the top documents with a score above 0.

    Repeated items (id and text) count once; items with one id and different
    texts are ranked each by itself. Null and empty items find nothing. Each row
    of docs is a document, so repeated rows are found as often; a null doc_id
    comes after all others of its score. Null and empty texts have no term and
    count nowhere. Where no document has a term there are no rows.

    Documents are read once: what is kept are lists of query terms, written as a
    table, from which frequencies and scores come. Each task inverts a shard of
    its documents at a time, and hands on the shard's top documents of an item.
    Query terms go to the tasks as hashes in broadcasts of bounded size."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    asked = written(item_terms(items, item_col, item_text_col), "item-terms")
    n_terms = asked.select("term").distinct().count()
    parts = max(1, -(-n_terms // TERMS))
    vocabulary = []
    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).select("term").distinct().toArrow()
        if rows.num_rows:
            vocabulary.append(context.broadcast(np.sort(rows.column(0).to_numpy().view(np.uint64))))
    held = written(postings(docs, vocabulary, id_col, text_col), "postings")
    n = held.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = n.documents, n.length or 1
    counts = frequencies(held)
    # a term that no document has is in no list
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(asked.join(counts, "term").select("item_id", "key", "term", (weight * F.col("reps")).alias("weight")), "weights")
    blocks = max(1, -(-weighed.count() // ITEM_TERMS))
    queries = []
    for b in range(blocks):
        rows = weighed.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow().sort_by("key")
        keys = rows.column("key").to_pylist()
        cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        ids = [rows.column("item_id")[k].as_py() for k in cuts]
        queries.append(context.broadcast((ids, [keys[k] for k in cuts], np.array([*cuts, len(keys)]), rows.column("term").to_numpy(), rows.column("weight").to_numpy())))
    forget(asked), forget(weighed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            ix = inverted(rows, documents, length)
            rows.clear()
            for ids, keys, first, terms, weights in (q.value for q in queries):
                found = [best(ix, terms[a:b], weights[a:b], top, short) for a, b in zip(first[:-1], first[1:], strict=True)]
                sizes = [len(p) for p, _ in found]
                if not sum(sizes):
                    continue
                p, s = (np.concatenate(x) for x in zip(*found, strict=True))
                item = np.repeat(np.arange(len(ids)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(item)), pa.array(keys, pa.string()).take(pa.array(item)), pa.array(ix.ids[p], mask=ix.null[p]), pa.array(s)], ["item_id", "key", "doc_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, tfs = batch.column(2), batch.column(3)
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            rows.append((ids, null, batch.column(1).to_numpy(), lists.flatten().to_numpy(), tfs.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)))
            size += len(rows[-1][3])
            if size >= shard:
                yield from out()
                size = 0
        if rows:
            yield from out()
        release()

    found = held.where(F.size("terms") > 0).mapInArrow(scored, "item_id long, key string, doc_id long, score long")
    place = Window.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all documents for all benchmark items; empty tables give no rows."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
