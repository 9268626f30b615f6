"""Operator 12: personal data by a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, release, table

#: Kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: A segment of the field has at most so many tokens and characters; base spans may be longer.
MAX_TOKENS, MAX_CHARS = 20, 64
#: Islands of the corpus and made ones that the field is fitted on, characters of one, passes, and what a span must be ahead of no span.
SAMPLE, MADE, ISLAND_CHARS, PASSES, MARGIN = 400, 700, 160, 6, 2.0
#: Scores that a worker remembers.
REMEMBERED = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is matched whole or not at all, so each is read a few times at most
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[(\[](?:at|AT)[)\]]|.", re.S)
_NEXT = re.compile(rf"\S{{0,{MAX_CHARS}}}")
_NOT_DIGIT = re.compile("[^0-9]+")
#: Words before a span that say what it is.
_CUES = {w: k for k, ws in enumerate(("mail email contact write", "ip host server address", "card visa mastercard amex pay", "phone tel call fax mobile dial", "version id order invoice isbn build ref code serial no")) for w in ws.split()}
_WORD_BEFORE = re.compile(r"([A-Za-z]{2,12})[:.]? ?\Z")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def small(part: str) -> bool:
    """If a run of digits is 255 at most, however many zeros it begins with."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1  # a local part has no @
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and without overlaps, sorted. Linear in the text's length."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold digits or an at sign: whole words of up to MAX_CHARS on either side, those one space apart together."""
    start = end = -2
    for m in _ANY.finditer(text):
        a = m.start()
        if a < end:
            continue
        word = text[max(0, a - MAX_CHARS, end) : a]
        if m.end() - a > 1 and word.endswith(" "):  # a spelt-out at sign stands between words
            word = word[:-1]
            left = a - 1 - len(word) + len(word.rstrip()) - len(word.rstrip().split()[-1]) if word.strip() else a
        else:
            left = a - (len(word.split()[-1]) if word and not word[-1].isspace() else 0)
        right = _NEXT.match(text, a).end()
        if m.end() - a > 1 and right == m.end() and text[right : right + 1] == " ":
            right = _NEXT.match(text, right + 1).end()
        if left <= end or (left == end + 1 and text[end] == " "):
            end = max(end, right)
            continue
        if end > start >= 0:
            yield start, end
        start, end = left, right
    if end > start >= 0:
        yield start, end


def _kind_of_char(c: str) -> str:
    return "^" if not c else "_" if c.isspace() else "9" if c.isdigit() else "a" if c.isalpha() else c if c in "@.+-/:=#\"'()" else "*"


def shape(segment: str) -> str:
    """Digits as 9, runs of letters as a."""
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", segment))


def key_of(island: str, a: int, b: int, before: str) -> tuple:
    """All that a segment's features look at: its shape, its neighbours, the word before it, and what its digits satisfy."""
    s = island[a:b]
    digits = _NOT_DIGIT.sub("", s)
    parts = s.split(".")
    ahead = island[max(0, a - 14) : a] or before
    cue = _WORD_BEFORE.search(ahead[-14:])
    valid = 12 <= len(digits) <= 19 and luhn(digits)
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    return shape(s), _kind_of_char(ahead[-1:]), _kind_of_char(island[b : b + 1]), _CUES.get(cue[1].lower(), -1) if cue else -1, valid, quad


def features(key: tuple) -> list[str]:
    """Features of a whole span."""
    s, left, right, cue, valid, quad = key
    n = s.count("9")
    runs = [len(x) for x in re.findall("9+", s)]
    marks = "".join(sorted(set(re.sub(r"[9a]|[(\[]a[)\]]", "", s))))
    at = s.count("@") + len(re.findall(r"[(\[]a[)\]]", s))
    tail = re.split(r"@| ?[(\[]a[)\]] ?", s)[-1]
    out = ["all", f"digits {min(n, 20)}", f"runs {len(runs)} {max(runs, default=0)}", f"marks {marks}", f"left {left}", f"right {right}", f"sides {left}{right}", f"starts {s[:1]}", f"ends {s[-1:]}", f"cue {cue}", f"valid {valid} {12 <= n <= 19}", f"quad {quad}"]
    if len(s) <= 24 and not at:
        out.append(f"shape {s}")
    if at:
        out += [f"at {at}", f"tail {re.sub('[9a-]+', 'x', re.sub('a', 'a', tail))[:6]}", f"at space {' ' in s}"]
    if "a" in s:
        out.append(f"letters {bool(at)}")
    return out


@dataclass
class Field:
    """Weights of features for each kind, and of a segment right after another one."""

    weights: dict[str, list[float]] = field(default_factory=dict)
    next_to: list[float] = field(default_factory=lambda: [0.0] * len(KINDS))
    known: dict[tuple, tuple[float, ...]] = field(default_factory=dict)

    def scores(self, key: tuple) -> tuple[float, ...]:
        found = self.known.get(key)
        if found is None:
            total = [0.0] * len(KINDS)
            for f in features(key):
                w = self.weights.get(f)
                if w:
                    total = [a + b for a, b in zip(total, w, strict=True)]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[key] = tuple(total)
        return found


@dataclass
class Lattice:
    """An island as tokens, with the segments that may be spans: by end, (begin, key)."""

    at: list[int]  # where tokens begin, and the end
    ending: list[list[tuple[int, tuple]]]


def lattice(island: str, before: str) -> Lattice:
    """Segments begin and end with letters, digits, + or (, hold an at sign, seven digits or three dots between digits, and no more white space than single spaces; a plus sign comes first or after letters."""
    tokens = _TOKEN.findall(island)
    at = [0]
    for t in tokens:
        at.append(at[-1] + len(t))
    ending: list[list[tuple[int, tuple]]] = [[] for _ in range(len(tokens) + 1)]
    kinds = [0 if t.isascii() and t.isdigit() else 1 if t.isascii() and t.isalpha() else 2 if t[0] in "([" and len(t) == 4 else 3 if t == "@" else 4 if t == " " else 5 if t in "._%+-()" else 6 for t in tokens]
    for i, k in enumerate(kinds):
        if k > 1 and tokens[i] not in "+(" or at[i + 1] - at[i] > MAX_CHARS:
            continue
        digits = signs = dots = letters = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            k = kinds[j]
            if k == 6 or at[j + 1] - at[i] > MAX_CHARS or (k == 4 and kinds[j - 1] == 4) or (j > i and not letters and tokens[j] == "+"):
                break
            digits += len(tokens[j]) if k == 0 else 0
            signs += k in (2, 3)
            dots += tokens[j] == "."
            letters += k == 1
            if k <= 1 and (signs == 1 or (not signs and not letters and (digits >= 7 or dots == 3))):
                ending[j + 1].append((i, key_of(island, at[i], at[j + 1], before)))
    return Lattice(at, ending)


def decode(x: Lattice, model: Field) -> list[tuple[int, int, int, float]]:
    """The best division into spans and tokens outside (start, kind, end, how far ahead of no span), by dynamic programming over ends."""
    n = len(x.ending)
    outside, inside = [0.0] * n, [-math.inf] * n  # best scores of what ends here outside, or with a span
    back: list[tuple[int, int, bool, float] | None] = [None] * n
    for j in range(1, n):
        outside[j] = max(outside[j - 1], inside[j - 1])
        for i, key in x.ending[j]:
            for k, s in enumerate(model.scores(key)):
                after = inside[i] + model.next_to[k] > outside[i]
                total = s + (inside[i] + model.next_to[k] if after else outside[i])
                if total > inside[j]:
                    inside[j], back[j] = total, (i, k, after, s)
    out, j = [], n - 1
    in_span = inside[j] > outside[j]
    while j > 0:
        if in_span:
            i, k, in_span, s = back[j]
            out.append((x.at[i], k, x.at[j], s))
            j = i
        else:
            j -= 1
            in_span = inside[j] > outside[j]
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expected(x: Lattice, model: Field) -> list[tuple[int, int, int, float, float]]:
    """(begin, end, kind, probability, that of standing right after another span) of each segment, by sums over all divisions."""
    n = len(x.ending)
    out_f, in_f = [0.0] + [-math.inf] * (n - 1), [-math.inf] * n
    scored = [[(i, model.scores(key)) for i, key in e] for e in x.ending]
    starting: list[list[tuple[int, tuple]]] = [[] for _ in range(n)]
    for j in range(1, n):
        out_f[j] = _add(out_f[j - 1], in_f[j - 1])
        for i, s in scored[j]:
            starting[i].append((j, s))
            for k, w in enumerate(s):
                in_f[j] = _add(in_f[j], w + _add(out_f[i], in_f[i] + model.next_to[k]))
    out_b, in_b = [-math.inf] * n, [-math.inf] * n
    out_b[-1] = in_b[-1] = 0.0
    for i in range(n - 2, -1, -1):
        out_b[i] = in_b[i] = out_b[i + 1]
        for j, s in starting[i]:
            for k, w in enumerate(s):
                out_b[i] = _add(out_b[i], w + in_b[j])
                in_b[i] = _add(in_b[i], w + model.next_to[k] + in_b[j])
    z = _add(out_f[-1], in_f[-1])
    found = []
    for j in range(1, n):
        for i, s in scored[j]:
            for k, w in enumerate(s):
                right_after = math.exp(in_f[i] + model.next_to[k] + w + in_b[j] - z)
                found.append((i, j, k, right_after + math.exp(out_f[i] + w + in_b[j] - z), right_after))
    return found


def made_islands(seed: int = 0, n: int = MADE) -> list[tuple[str, str, list[tuple[int, int, int]]]]:
    """Islands made by rule, with their spans: personal data in plain and in usual other forms, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card(k: int, valid: bool) -> str:
        while luhn(d := digits(k)) != valid:
            pass
        return d

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def entity() -> tuple[int, str]:
        k = rng.randrange(4)
        if k == 0:
            local = name() + rng.choice(["", "." + name(), digits(2), "_" + name()])
            return 0, f"{local}{rng.choice(['@', '@', '(at)', ' (at) ', '[at]', ' [at] '])}{name()}{rng.choice(['', '-' + name(), digits(1)])}.{rng.choice(['com', 'org', 'net', 'co.uk', 'example.com'])}"
        if k == 1:
            return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if k == 2:
            return 2, grouped(card(rng.choice([13, 15, 16, 16, 16, 19]), True), rng.choice(["", "", " ", "-", "."]))
        area, a, b = digits(3), digits(3), digits(4)
        return 3, rng.choice([f"+1 ({area}) {a}-{b}", f"+{digits(2, '123456789')} {area} {a} {b}", f"+1-{area}-{a}-{b}", f"+{digits(11, '123456789')}", f"({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}"])

    def other() -> str:
        d = digits
        return rng.choice([
            lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}", lambda: f"{d(2)}.{d(1)}.{d(1)}", lambda: f"{d(3)},{d(3)}.{d(2)}", lambda: d(rng.randint(1, 9)),
            lambda: card(rng.randint(12, 19), False), lambda: grouped(card(16, False), rng.choice(" -")), lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"@{name()}", lambda: f"{name()}@{name()}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: d(rng.randint(20, 30)), lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: d(10), lambda: d(11),
        ])()

    out = []
    for _ in range(n):
        before = rng.choice(["", "", f"{name()} ", f"{name()}: ", f"{rng.choice(list(_CUES))} ", f"{rng.choice(list(_CUES))}: ", "(", '"', "="])
        text, spans = "", []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            text += " " if text else ""
            if rng.random() < 0.55:
                k, e = entity()
                spans.append((len(text), k, len(text) + len(e)))
                text += e
            else:
                text += other()
            text += rng.choice(["", "", "", ".", ",", "!!", "***", ")", '"'])
        out.append((text, before, spans))
    return out


def fit(corpus: list[tuple[str, str]], made: int = MADE, passes: int = PASSES) -> Field:
    """The field of largest likelihood, by adaptive gradient steps, on islands of the corpus (their base spans are its spans) and on made ones."""
    rows = [(lattice(text, before), spans) for text, before, spans in made_islands(0, made)]
    shapes = set()
    for text, before in sorted(corpus):
        seen = (shape(text), shape(before[-8:]))
        if seen not in shapes:
            shapes.add(seen)
            rows.append((lattice(text, before), base_spans(text)))
    model, squares = Field(), defaultdict(lambda: [1e-6] * len(KINDS))
    rng = random.Random(1)
    for _ in range(passes):
        rng.shuffle(rows)
        for x, spans in rows:
            model.known.clear()
            places = {a: k for k, a in enumerate(x.at)}
            gold = {(places.get(a), places.get(b), k) for a, k, b in spans}
            ends = {b for _, b, _ in gold}
            keys = {(i, j): key for j, e in enumerate(x.ending) for i, key in e}
            step: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))
            for i, j, k, p, after in expected(x, model):
                g = ((i, j, k) in gold) - p
                if abs(g) > 1e-3:
                    for f in features(keys[i, j]):
                        step[f][k] += g
                step["next"][k] += ((i, j, k) in gold and i in ends) - after
            for f, gs in step.items():
                w = model.next_to if f == "next" else model.weights.setdefault(f, [0.0] * len(KINDS))
                for k, g in enumerate(gs):
                    if g:
                        squares[f][k] += g * g
                        w[k] += 0.5 * g / math.sqrt(squares[f][k]) - 1e-4 * w[k]
    model.known.clear()
    return model


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, made: int = MADE) -> Field:
    """A field fitted on at most sample islands (ISLAND_CHARS characters each) of the corpus, those with the smallest hashes, and on made ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(text[a:b], text[max(0, a - 16) : a]) for text in batch.column(0).to_pylist() if text for a, b in islands(text) if b - a <= ISLAND_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["island", "before"])

    # one island of a shape says as much as a thousand
    shaped = F.regexp_replace(F.regexp_replace("island", "[0-9]", "9"), "[A-Za-z]+", "a")
    found = docs.select(text_col).mapInArrow(cut, "island string, before string").groupBy(shaped.alias("shape")).agg(F.min(F.struct("island", "before")).alias("one"))
    rows = found.orderBy(F.xxhash64("shape"), "shape").limit(sample).select("one.*").collect()
    return fit([(r.island, r.before) for r in rows], made)


def spans_of(text: str, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the field adds where no base span is; (start, kind, end)."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    added, k = [], 0
    high = 0  # the farthest end of base spans passed
    for a, b in islands(text):
        for start, kind, end, ahead in decode(lattice(text[a:b], text[max(0, a - 16) : a]), model):
            start, end = start + a, end + a
            while k < len(base) and base[k][0] < end:
                high = max(high, base[k][2])
                k += 1
            if ahead >= MARGIN and high <= start:
                added.append((start, kind, end))
    return base, added


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as its kind in brackets; of spans that overlap, the first one's kind stands for all."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out.append(text[at:a] + f"[{KINDS[k]}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and redacted (the text without personal data) if with_text.

    Base spans all stay; the field's spans come beside them, never over them.
    Null text is empty; texts without digits and at signs have no spans. Null
    ids and repeated rows come back as they are; rows aren't moved. Work is
    linear in a text's length: segments have MAX_TOKENS tokens at most."""
    counts = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string" + ", redacted string" * with_text + carried(docs, carry)
    names = ["doc_id", *counts, "base_sha256", "spans", *["redacted"] * with_text, *carry]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base, added = spans_of(text, model)
                rows.append(([sum(s[1] == k for s in base) for k in range(len(KINDS))], hashlib.sha256(told(base).encode()).hexdigest(), told(base + added)))
                if with_text:
                    texts.append(redacted(text, base + added))
            columns = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(texts, pa.string())] if with_text else []), *batch.columns[2:]], names)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(found, schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """personal_data() of all documents by a field fitted on a bounded sample of their own islands; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, learn(docs))
