"""Operator 11: the prefix trie of conversations, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, release, spread_join, table, written

#: Turns of a conversation that one window orders and adds up; a longer conversation is several.
BLOCK = 4096
#: Nodes of a component that one task decomposes; larger ones are split by Spark first.
COMPONENT = 1 << 16
#: Components that a task takes together have so many nodes, about.
TOGETHER = 1 << 16
#: Conversations of a node that make one string before it is hashed.
CHUNK = 4096

_KEY, _PARENT, _TOP, _COMP = ["ka", "kb"], ["pa", "pb"], ["fa", "fb"], ["ca", "cb"]
_VALUES = ["n_leaves", "saved_tokens"]


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1 in the order of turns), ta, tb (128 bits of role and text), words: a table.

    Turns are dealt by ranges of (conversation, turn), so a long conversation
    is several partitions; only the first conversation of a partition can have
    begun before it, so what ranks move by is one row a partition."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    light = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(role, text).alias("ta"), F.xxhash64(F.lit(1), text, role).alias("tb"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    dealt = light.repartitionByRange("conv", "turn", "ta", "tb").withColumn("pid", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("pid", "conv").orderBy("turn", "ta", "tb"))
    placed = written(dealt.select("conv", "pid", place.cast("long").alias("place"), "ta", "tb", "words"), "placed")
    counts = placed.groupBy("conv", "pid").agg(F.count("*").alias("n"))
    before = counts.select("conv", "pid", F.sum("n").over(Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before is not null")
    moved = placed.join(F.broadcast(before), ["conv", "pid"], "left")
    out = written(moved.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "ta", "tb", "words"), "turns")
    forget(placed)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % 20 in place of its own first h; h = crc32(c) % 4.

    Returns turns (conv, pos, ta, tb, words, length) and conversations (conv,
    length), those without turns too; both are tables."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    heads = turns.where("conv % 20 = 0 and pos <= 3").select(F.col("conv").alias("base"), "pos", "ta", "tb", "words")
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h.alias("h"), F.expr("conv - conv % 20").alias("base"))
    known = own.join(heads.groupBy("base").agg(F.count("*").alias("nb")), "base", "left").withColumn("share", F.least("h", F.coalesce("nb", F.lit(0))))
    known = written(known.select("conv", "base", "h", "share", (F.col("share") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "conversations")
    kept = spread_join(turns.where(F.col("pos") > h), known.select("conv", "h", "share", "length"), ["conv"]).select("conv", (F.col("pos") - F.col("h") + F.col("share")).alias("pos"), "ta", "tb", "words", "length")
    given = known.where("share > 0").select("conv", "base", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share").cast("long"))).alias("pos")).join(heads, ["base", "pos"]).select("conv", "pos", "ta", "tb", "words", "length")
    return written(kept.union(given), "rebuilt"), known.select("conv", "length")


def paths(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, depth, node (ka, kb), its parent (pa, pb), the node of the first turn (fa, fb), words, last: one row a turn, a table.

    A node is 128 bits: the exclusive or of hashes of (place, turn) over its
    sequence. So a conversation's nodes are running sums within blocks, each
    moved by the sum of the blocks before."""
    cut = turns.select("conv", F.col("pos").alias("depth"), "words", "length", F.xxhash64("pos", "ta", "tb").alias("xa"), F.xxhash64(F.lit(7), "tb", "pos", "ta").alias("xb"), F.floor((F.col("pos") - 1) / block).alias("block"))
    running = Window.partitionBy("conv", "block").orderBy("depth")
    so_far = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the first block begins with the first turn; later blocks are told of it
    rows = cut.select("conv", "depth", "words", "length", "block", "xa", "xb", *[F.bit_xor(f"x{s}").over(so_far).alias(f"k{s}") for s in "ab"], *[F.first(f"x{s}").over(running).alias(f"f{s}") for s in "ab"])
    blocks = cut.where(F.col("length") > block).groupBy("conv", "block").agg(*[F.bit_xor(f"x{s}").alias(f"t{s}") for s in "ab"], *[F.max(F.when(F.col("depth") == 1, F.col(f"x{s}"))).alias(f"g{s}") for s in "ab"])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moves = blocks.select("conv", "block", *[F.bit_xor(f"t{s}").over(earlier).alias(f"b{s}") for s in "ab"], *[F.max(f"g{s}").over(earlier).alias(f"g{s}") for s in "ab"]).where("block > 0")
    rows = rows.join(moves, ["conv", "block"], "left")
    key = {s: F.col(f"k{s}").bitwiseXOR(F.coalesce(f"b{s}", F.lit(0))) for s in "ab"}
    return written(rows.select("conv", "depth", *[key[s].alias(f"k{s}") for s in "ab"], *[key[s].bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s in "ab"], *[F.coalesce(f"g{s}", f"f{s}").alias(f"f{s}") for s in "ab"], "words", (F.col("depth") == F.col("length")).alias("last")), "paths")


def trie(along: DataFrame) -> DataFrame:
    """The nodes of paths(): node, parent, top node, depth, owner (smallest conversation), n_convs, n_children, and its own part of what is rolled up; a table."""
    nodes = along.groupBy(*_KEY).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", *_PARENT, *_TOP, "words")])
    kids = nodes.groupBy(*_PARENT).agg(F.count("*").alias("n_children")).select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_children")
    found = nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return written(found.select(*_KEY, *_PARENT, *_TOP, "depth", "owner", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "nodes")


def _ids(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair (x, y) the index of the equal pair (a, b), which don't repeat; -1 where none is."""
    n = len(a)
    first, second = np.concatenate([a, x]), np.concatenate([b, y])
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.full(len(order), -1)
    at[which[:n]] = np.arange(n)
    return at[which[n:]]


def decomposed(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (nodes x columns) over each node's subtree. parent: index of a node's parent, -1 for tops of trees.

    Each round takes every component's centroid, the deepest node that has over
    half of it below. What the centroid has in the component, itself and the
    components below it, is added to all nodes on the way from it to the
    component's top; then it goes, and the component falls into parts of half
    its size at most. A node has its sum when it goes."""
    n = len(parent)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []
    size = np.ones(n, np.int64)
    for level in reversed(levels):
        inner = level[parent[level] >= 0]
        np.add.at(size, parent[inner], size[inner])
    # places in an order in which each subtree is a range
    place = np.zeros(n, np.int64)
    tops = np.flatnonzero(parent < 0)
    place[tops] = np.cumsum(size[tops]) - size[tops]
    for level in levels:
        inner = level[parent[level] >= 0]
        inner = inner[np.argsort(parent[inner], kind="stable")]
        if len(inner):
            upto = np.cumsum(size[inner]) - size[inner]
            first = np.flatnonzero(np.append(True, parent[inner][1:] != parent[inner][:-1]))
            start = np.repeat(upto[first], np.diff(np.append(first, len(inner))))
            place[inner] = place[parent[inner]] + 1 + upto - start
    order = np.argsort(place)
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    own, whole = values[order], size[order]
    below = whole.copy()  # nodes below in the component, itself included
    total = np.zeros_like(own)
    part = np.cumsum(up < 0) - 1
    active = np.arange(n)
    while len(active):
        order_ = np.argsort(part[active], kind="stable")
        active = active[order_]
        _, mine = np.unique(part[active], return_inverse=True)
        count = np.bincount(mine)
        on_way = 2 * below[active] > count[mine]
        centre = np.full(len(count), -1)
        np.maximum.at(centre, mine[on_way], active[on_way])  # the deepest of a path is the last
        c = centre[mine]
        under = (active >= c) & (active < c + whole[c])
        held = np.zeros((len(count), own.shape[1]), own.dtype)
        np.add.at(held, mine[under], own[active[under]])
        way = active[on_way]
        total[way] += held[mine[on_way]]
        shrink = below[centre].copy()
        below[way] -= np.where(way == c[on_way], 0, shrink[mine[on_way]])
        # the parts: what is left above keeps the component's number, each child of the centroid begins one
        begins = np.cumsum(up[active] == c)
        label = np.where(under, len(count) + begins, mine)
        keep = active != c
        active, label = active[keep], label[keep]
        part[active] = label
    out = np.empty_like(total)
    out[order] = total
    return out


def _locally(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Rolls up components (ca, cb) of bounded size, each in a task; what split() has added before (_VALUES with so_far_) comes on top."""

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(t: pa.Table) -> pa.Table:
            col = lambda c: t.column(c).to_numpy()
            parent = _ids(col("ka"), col("kb"), col("pa"), col("pb"))
            sums = decomposed(parent, col("depth"), np.stack([col(v) for v in _VALUES], axis=1))
            for k, v in enumerate(_VALUES):
                t = t.set_column(t.column_names.index(v), v, pa.array(sums[:, k] + col(f"so_far_{v}")))
            return t.select(names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                t = pa.Table.from_batches(held)
                a, b = t.column("ca").to_numpy(), t.column("cb").to_numpy()
                cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                if len(cut):  # the last component may go on in the next batch
                    k = int(cut[-1]) + 1
                    yield from out(t.slice(0, k).combine_chunks()).to_batches()
                    held = t.slice(k).combine_chunks().to_batches()
                    rows = t.num_rows - k
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks()).to_batches()
        release()

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    return nodes.repartition(*_COMP).sortWithinPartitions(*_COMP).mapInArrow(rolled, ", ".join(f"{c} {kinds[c]}" for c in names))


def split(nodes: DataFrame, along: DataFrame, component: int) -> tuple[DataFrame, DataFrame]:
    """Rounds of the decomposition for trees of more than component nodes, as joins: returns centroids that are done, and components small enough for a task.

    nodes: those of large trees, a table. A node's subtree holds what its
    members own below it, so its size is a sum over paths. Whether a node is
    below a centroid is looked up on its owner's path. What is broadcast is a
    row for each component of more than component nodes, so fewer rows than
    nodes over component."""
    owned = nodes.groupBy("owner").agg(F.count("*").alias("own"), F.min("depth").alias("begins"))
    trees = F.broadcast(nodes.where("depth = 1").select(F.col("ka").alias("fa"), F.col("kb").alias("fb")))
    members = written(along.join(trees, _TOP, "left_semi").select("conv", "depth", *_KEY, *_PARENT), "members")
    sizes = spread_join(members, owned.withColumnRenamed("owner", "conv"), ["conv"]).groupBy(*_KEY).agg(F.sum("own").alias("held"))
    begun = spread_join(nodes, owned.select("owner", "begins"), ["owner"])
    state = begun.join(sizes, _KEY).withColumn("below", F.expr("held - (depth - begins)")).drop("held", "begins")
    state = written(state.withColumns({"ca": F.col("fa"), "cb": F.col("fb")} | {f"so_far_{v}": F.lit(0).cast("long") for v in _VALUES}), "components")
    done, ready = [], []
    steps = members.select(F.col("conv").alias("owner"), F.col("depth").alias("at"), F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("pa").alias("va"), F.col("pb").alias("vb"))
    while True:
        large = state.groupBy(*_COMP).agg(F.count("*").alias("members")).where(F.col("members") > component)
        large = written(large, "large")
        ready.append(state.join(F.broadcast(large), _COMP, "left_anti"))
        if large.isEmpty():
            return _all(done, state), _all(ready, state)
        active = state.join(F.broadcast(large), _COMP)
        on_way = F.expr("2 * below > members")
        centre = active.where(on_way).groupBy(*_COMP).agg(F.max(F.struct("depth", "ka", "kb", "below")).alias("c"))
        centre = written(centre.select(*_COMP, F.col("c.depth").alias("c_depth"), F.col("c.ka").alias("c_ka"), F.col("c.kb").alias("c_kb"), F.col("c.below").alias("c_below")), "centres")
        met = written(active.join(F.broadcast(centre), _COMP).withColumn("at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1)), "met")
        is_centre = F.expr("ka = c_ka and kb = c_kb")
        placed = spread_join(met, steps, ["owner", "at"], "left").withColumn("under", F.coalesce(F.expr("va = c_ka and vb = c_kb"), F.lit(False)))
        placed = written(placed, "placed")
        held = written(placed.where(F.col("under") | is_centre).groupBy(*_COMP).agg(*[F.sum(v).alias(f"add_{v}") for v in _VALUES]), "held")
        after = placed.join(F.broadcast(held), _COMP)
        after = after.withColumns({f"so_far_{v}": F.col(f"so_far_{v}") + F.when(on_way, F.col(f"add_{v}")).otherwise(0) for v in _VALUES} | {"below": F.when(on_way & ~is_centre, F.col("below") - F.col("c_below")).otherwise(F.col("below")), "ca": F.when(F.col("under"), F.col("ua")).otherwise(F.col("ca")), "cb": F.when(F.col("under"), F.col("ub")).otherwise(F.col("cb"))})
        whole = written(after.select(*state.columns, is_centre.alias("centre")), "split")
        done.append(whole.where("centre").drop("centre"))
        state = whole.where("not centre").drop("centre")


def _all(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = parts[0] if parts else like.limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rolled_up(nodes: DataFrame, along: DataFrame, component: int = COMPONENT) -> DataFrame:
    """nodes of trie() with n_leaves and saved_tokens summed over subtrees: each tree below the root is a component to begin with."""
    names = nodes.columns
    fresh = {"ca": F.col("fa"), "cb": F.col("fb")} | {f"so_far_{v}": F.lit(0).cast("long") for v in _VALUES}
    large = nodes.groupBy(*_TOP).agg(F.count("*").alias("n")).where(F.col("n") > component).select(*_TOP)
    large = written(large, "large-trees")
    if large.isEmpty():
        return _locally(nodes.withColumns(fresh), names)
    few = F.broadcast(large)
    centres, parts = split(written(nodes.join(few, _TOP, "left_semi"), "large-nodes"), along, component)
    small = nodes.join(few, _TOP, "left_anti").withColumns(fresh)
    whole = centres.withColumns({v: F.col(f"so_far_{v}") for v in _VALUES}).select(*names)
    return _locally(small.unionByName(parts.select(*small.columns)), names).unionByName(whole)


def ends_of(ends: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256: the SHA-256 of each node's conversations (conv), ascending, comma-joined.

    Ranges of (node, conversation) are joined to strings of CHUNK conversations
    each; a node's strings then stream through one hash, which is all that has
    to be done in turn."""

    def groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, list]]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)] if len(a) else [0]
            values = batch.column(n).to_pylist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(a[i]), int(b[i]), values[i:j]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, str]] = []
        key, held = None, []
        for a, b, convs in groups(batches, 2):
            if (a, b) != key:
                if held:
                    out.append((*key, held[0], ",".join(map(str, held))))
                key, held = (a, b), []
            held += convs
            while len(held) > CHUNK:
                out.append((a, b, held[0], ",".join(map(str, held[:CHUNK]))))
                held = held[CHUNK:]
            if len(out) >= CHUNK:
                yield pa.RecordBatch.from_pylist([dict(zip(("ka", "kb", "at", "text"), r, strict=True)) for r in out], pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("at", pa.int64()), ("text", pa.string())]))
                out = []
        if held:
            out.append((*key, held[0], ",".join(map(str, held))))
        yield pa.RecordBatch.from_pylist([dict(zip(("ka", "kb", "at", "text"), r, strict=True)) for r in out], pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("at", pa.int64()), ("text", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ka", "kb", "ends_sha256"]
        out: list[tuple[int, int, str]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names)
        key, digest = None, None
        for a, b, texts in groups(batches, 3):
            if (a, b) != key:
                if digest is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(texts).encode())
            if len(out) >= CHUNK:
                yield pack()
                out.clear()
        if digest is not None:
            out.append((*key, digest.hexdigest()))
        yield pack()

    order = ["ka", "kb", "conv"]
    strings = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "ka long, kb long, at long, text string")
    return strings.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "at").mapInArrow(hashed, "ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, known: DataFrame, component: int = COMPONENT, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    turns: conv, pos, ta, tb, words, length; known: conv, length, one row a
    conversation, which may have no turns. Both are tables. Without any
    conversation there is no root, so no row."""
    along = paths(turns, block)
    nodes = trie(along)
    rolled = written(rolled_up(nodes, along, component), "rolled")
    all_ = known.agg(F.count("*").alias("n"), F.min("conv").alias("first")).first()
    # a parent's conversation is looked up; nodes of the first turn have the root's
    named = spread_join(rolled.where("depth > 1"), rolled.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("owner").alias("parent_conv_id")), _PARENT)
    columns = [*_KEY, "owner", "depth", "parent_conv_id", "n_convs", "n_children", *_VALUES]
    tops = rolled.where("depth = 1").withColumn("parent_conv_id", F.lit(all_.first).cast("long"))
    zero: Column = F.lit(0).cast("long")
    root = rolled.where("depth = 1").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), zero), F.lit(1).cast("long")).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = root.withColumns({"ka": zero, "kb": zero, "owner": F.lit(all_.first).cast("long"), "depth": zero, "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(all_.n).cast("long")}).where("n_convs > 0")
    found = named.select(*columns).unionByName(tops.select(*columns)).unionByName(root.select(*columns))
    ends = along.where("last").select(*_KEY, "conv").union(known.where("length = 0").select(zero.alias("ka"), zero.alias("kb"), "conv"))
    out = found.join(ends_of(ends), _KEY, "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *_VALUES, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversations_trie(conversations: DataFrame, as_given: bool = False, component: int = COMPONENT, block: int = BLOCK) -> DataFrame:
    """prefix_trie() of conversations (conv_id, turn, role, text), rebuilt() first or as_given.

    Turns are ordered by turn, null first; equal turns by hashes of role and
    text, so their order is the same in every conversation; repeated rows are
    turns of their own. Null roles and texts are empty; rows without a conv_id
    belong to no conversation. An empty table gives no rows."""
    turns = numbered(conversations)
    if as_given:
        known = written(turns.groupBy("conv").agg(F.count("*").alias("length")), "conversations")
        return prefix_trie(spread_join(turns, known, ["conv"]), known, component, block)
    return prefix_trie(*rebuilt(turns), component, block)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations_trie() of the whole table."""
    return conversations_trie(table(spark, sf_dir, "conversations"))
