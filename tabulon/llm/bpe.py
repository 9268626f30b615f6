"""Operator 10: BPE encoding by backtracking over longest matches, decoding by an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, release, table

#: Entries of each generation of a worker's caches; a cache has two. Longer words aren't kept.
CACHED, KEPT_CHARS = 60_000, 48


class Recent(dict):
    """What make gives for each key, kept for keys used lately: a full generation becomes the old one, and only what is asked for again comes back from it."""

    def __init__(self, make: Callable, most: int = CACHED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value, keep = self.make(key)
            if not keep:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.old = {}
        self.clear()


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Exact byte-level BPE of a tokenizer file, without running merges.

    A token sequence is what the merges give if and only if each neighbouring
    pair is compatible: no merge that ranks before those of its two tokens'
    inner merges could join them across their border. So the encoder takes the
    longest token that matches, keeps it if it is compatible with the token
    before, else tries the next shorter one, and steps back where none is left;
    positions that failed once aren't tried again, which keeps this linear."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        raw = {w: bytes(letters[c] for c in w) for w in model["vocab"]}
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for w, i in model["vocab"].items():
            self.tokens[i] = raw[w]
            self.ids[raw[w]] = i
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank: 0 for bytes, else 1 + place in the list of merges. halves: what a token is merged from.
        self.rank = [0] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            x, y, z = self.ids[raw[a]], self.ids[raw[b]], self.ids[raw[a] + raw[b]]
            if (x, y) not in self.joined:
                self.joined[x, y] = k + 1
            if self.halves[z] is None:
                self.halves[z], self.rank[z] = (x, y), k + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        # Aho-Corasick over the tokens as Latin-1 text; shorter: the longest token that is a proper prefix of each
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for t, i in self.ids.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := self.ids.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.apart = Recent(self._apart)
        # letters come first, as most words are: no other alternative starts as they do
        split = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.split = regex.compile(split).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        # the offset table of decoding: all tokens' bytes end to end
        self.table = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offset[1:])
        self.words = Recent(lambda w: (array("I", self.encode_word(w.encode())).tobytes(), len(w) <= KEPT_CHARS))

    def _apart(self, pair: int) -> tuple[bool, bool]:
        """If the tokens a and b of a pair (a << 32 | b) stay apart when merges run over their joined bytes."""
        x, y = pair >> 32, pair & 0xFFFFFFFF
        # undo the merges of both sides from the last one on; limit: the rank of the merge undone last
        limit = 1 << 60
        out = True
        while True:
            if (r := self.joined.get((x, y))) is not None and r < limit:
                out = False
                break
            if self.halves[x] is None and self.halves[y] is None:
                break
            # of equal ranks the left one was merged first, so the right one is undone first
            if self.rank[x] > self.rank[y]:
                limit, x = self.rank[x], self.halves[x][1]
            else:
                limit, y = self.rank[y] + 1, self.halves[y][0]
        return out, True

    def compatible(self, a: int, b: int) -> bool:
        return self.apart[a << 32 | b]

    def encode_word(self, word: bytes) -> list[int]:
        """Longest matches from the left if all neighbours are compatible; else on from the first that aren't, with steps back."""
        if (token := self.ids.get(word)) is not None:
            return [token]
        text, apart, first, at = word.decode("latin-1"), self.apart, {}, 0
        for end, i in self.automaton.iter_long(text):
            first[at] = i
            at = end + 1
        out = [*first.values()]
        before = out[0] if out else -1
        for k, token in enumerate(out[1:], 1):
            if not apart[before << 32 | token]:
                return self.backtrack(text, first, out[:k])
            before = token
        return out

    def backtrack(self, text: str, first: dict[int, int], out: list[int]) -> list[int]:
        """out: tokens found so far, compatible all. first: the longest matches known, by place."""
        apart, tokens, shorter, longest = self.apart, self.tokens, self.shorter, self.automaton.iter_long
        dead: set[int] = set()
        size, at = len(text), sum(len(tokens[i]) for i in out)
        token = first[at]
        while at < size:
            while token >= 0:
                end = at + len(tokens[token])
                if end not in dead and (not out or apart[out[-1] << 32 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < size and (token := first.get(at, -1)) < 0:
                    token = first[at] = next(longest(text, at))[1]
            else:
                dead.add(at)
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text become their ids."""
        ids, out = self.words.__getitem__, []
        for k, part in enumerate(self.parts(text) if self.parts and any(s in text for s in self.special) else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(ids, self.split(part)))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        start = self.offset[ids]
        n = self.offset[ids + np.uint32(1)] - start
        total = int(n.sum())
        if not total:
            return b""
        # each byte's place in the table: 1 beyond the last one's, or the start of the next token
        step = np.ones(total, np.int64)
        head = np.cumsum(n[:-1])
        step[0] = start[0]
        step[head] = start[1:] - (start[:-1] + n[:-1] - 1)
        return self.table[np.cumsum(step)].tobytes()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array of int; if with_ids), and the columns to carry.

    A null text is encoded as an empty one. path names the tokenizer file on
    every executor. Rows keep their partition; nothing is shuffled. Null ids and
    repeated rows come back as they are."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")] + list(carry)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                n, ids_sha, text_sha, lists = [], [], [], []
                for text in piece.column(1):
                    ids = c.encode(text.as_py() or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                columns = [piece.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns + piece.columns[2:], names)
        # the worker lives on, and other operators' tasks come next
        c.words.forget(), c.apart.forget()
        release()

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *carry).mapInArrow(encoded, schema + carried(docs, carry))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bpe_tokens() of all documents without the ids; an empty table gives no rows."""
    return bpe_tokens(table(spark, sf_dir, "documents"), with_ids=False)
