"""Operator 3: main text of web pages by templates deduced from equivalence classes of tokens."""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Pages of one host that a task reads at a time, about, and bytes of equal pages that it may.
GROUP_PAGES, HOT_BYTES = 150, 32 << 20

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
_EDGE = re.compile("[>\"']")
#: Elements whose content is no markup of the page, with what ends them.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea select svg iframe title".split()}
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that hold blocks, elements that end a block, and elements that can't hold anything.
_HOLDERS = frozenset("html head body article main section div nav header footer aside form ul ol dl table figure blockquote details dialog menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a holder has or is without says nothing about the holder itself.
_ABOUT = re.compile(r"\b(?:has|with|without|no|is|not)[-_][^\s]+")
#: Holders whose text is no article text, by name or by a word of class, id or role.
_APART = frozenset("head nav header footer aside form menu dialog".split())
_APART_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|navi?|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|widget|"
    r"header|masthead|footer|comments?|disqus|respond|replies|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|pagination|pager|toolbar|skip|copyright|complementary|contentinfo)(?:$|[^a-z])"
)


@dataclass(slots=True)
class Block:
    path: str
    apart: bool
    inside: bool  # of an article or main element
    linked: float  # share of its characters that are link text
    text: str
    at: int = 0  # tokens of the page before it


def text_token(block: Block) -> str:
    """A block as one token: words that stand elsewhere too don't hide that it repeats."""
    return f"{block.path} \0{block.text}"


def pieces(page: str, at: int = 0) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Tags (start, end, name, if closing, attributes) and what holds no text of the page (its name is None), from at on in one pass.

    Quotes hide what they enclose from a tag's end. Where a tag's quotes don't
    close before the page ends, quotes hide nothing from there on; a tag
    without an end is none."""
    last, quotes = page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if at > last or page.startswith("<!--", at):
            if (at := page.find("<!--", at)) < 0:
                return
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, None, False, ""
        elif not (m := _NAME.match(page, at)):
            end = at + 1
        elif not m[1] and (stop := _RAW.get(m[2].lower())):
            found = stop.search(page, page.find(">", at))
            end = found.end() if found else len(page)
            yield at, end, None, False, ""
        elif page.startswith(">", m.end()):
            end = m.end() + 1
            yield at, end, m[2].lower(), bool(m[1]), ""
        else:
            end = m.end()
            while quotes and (edge := _EDGE.search(page, end)):
                end = edge.end() if edge[0] == ">" else page.find(edge[0], edge.end()) + 1
                if edge[0] == ">" or not end:
                    break
            if not quotes or not end or page[end - 1] != ">" or end == m.end():
                quotes = False
                end = page.find(">", m.end()) + 1
            yield at, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        at = end


def _alternatives() -> str:
    """What pieces() finds where a page is regular: comments, declarations, elements of _RAW, and tags whose quotes close."""
    end = "(?![a-zA-Z0-9-])"
    raw = [rf"(?ai:{n}){end}[^>]*+>[^<]*+(?:<(?!/(?i:{n})\s*>)[^<]*+)*+</(?i:{n})\s*>" for n in _RAW]
    tag = rf"(?!(?ai:{'|'.join(_RAW)}){end})/?+[a-zA-Z][a-zA-Z0-9-]*+(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
    return "|".join(["!--[^-]*+(?:-(?!->)[^-]*+)*+-->", "!(?!--)[^>]*+>", r"\?[^>]*+>", *raw, tag])


#: A regular piece; a page's pieces, the last of which runs from the first that is not regular to the page's end.
_PIECE = re.compile(f"<(?:{_alternatives()})")
_PIECES = re.compile(f"(<(?:{_alternatives()}|(?=[!?]|/?[a-zA-Z])(?s:.*)))")
#: Sources of tags, and characters of paths, that a reader remembers.
_TAGS, _PATHS = 1 << 14, 1 << 22
_NONE: tuple[set[str], set[str]] = set(), set()
_SKIP, _SPACE, _LINK, _UNLINK, _PLAIN, _END = range(6)
#: What a tag says: one of these, or its name, if it closes, and the holder's marks.
_Said = int | tuple[str, bool, str]


@dataclass(slots=True, eq=False)
class _Holder:
    """Where a page's open elements are: tags lead from one to another."""

    name: str
    path: str
    apart: bool
    inside: bool  # of an article or main element
    above: _Holder | None
    moves: dict[_Said, tuple[str | None, _Holder]] = field(default_factory=dict)


def _said(name: str | None, closing: bool, attributes: str) -> _Said:
    if name is None:
        return _SKIP
    if name == "a":
        return _UNLINK if closing else _LINK
    if name in _INLINE:
        return _PLAIN
    if name == "br":
        return _SPACE
    marks = " ".join(sorted({(a or b or c).strip().lower() for a, b, c in _MARK.findall(attributes)})) if attributes and not closing and name in _HOLDERS else ""
    return name, closing, marks


class _Reader:
    """Reads pages one after another, with wanted tokens alone, if any are named; remembers what tags say and where they lead."""

    def __init__(self, wanted: frozenset[str] | None = None) -> None:
        self.wanted = wanted
        words: dict[str, set[str]] = defaultdict(set)
        for path, word in (t.rsplit(" ", 1) for t in wanted or () if " " in t):
            words[path].add(word)
        #: words that are wanted in each path, and what they begin with
        self.words = {path: (ws, {w[:1] for w in ws}) for path, ws in words.items()}
        self.tags: dict[str, _Said] = {}
        self.top, self.chars = _Holder("", "", False, False, None), 0

    def say(self, source: str) -> _Said:
        m = _NAME.match(source)
        if not m or (not m[1] and m[2].lower() in _RAW):
            return _SKIP
        said = _said(m[2].lower(), bool(m[1]), source[m.end() : -1])
        if len(source) <= 256:
            if len(self.tags) >= _TAGS:
                self.tags.clear()
            self.tags[source] = said
        return said

    def move(self, holder: _Holder, said: tuple[str, bool, str]) -> tuple[str | None, _Holder]:
        """The tag's token, if it is wanted, and the holder after it."""
        name, closing, marks = said
        to = holder
        if name not in _HOLDERS:
            token = f"{holder.path} <{'/' * closing}{name}>"
        elif closing:
            token = f"{holder.path} </{name}>"
            up = holder
            while up.above and up.name != name:
                up = up.above
            to = up.above or holder
        else:
            token = f"{holder.path} <{name} {marks}>"
            path = f"{holder.path}/{name}" + (f".{marks}" if marks else "")
            # an article's own head still holds its title
            apart = holder.apart or (name in _APART and not (name == "header" and holder.inside)) or bool(marks and (holder.inside or name not in ("html", "body", "article", "main")) and _APART_WORDS.search(_ABOUT.sub(" ", marks)))
            to = _Holder(name, path, apart, holder.inside or (name in ("article", "main") and not holder.apart), holder)
            self.chars += len(path)
        self.chars += len(token)
        holder.moves[said] = out = (token if self.wanted is None or token in self.wanted else None, to)
        return out

    def tags_of(self, page: str) -> Iterator[tuple[str, _Said]]:
        """Each tag with the text before it, then the text after the last."""
        parts = _PIECES.split(page)
        rest = parts.pop()
        odd = parts.pop() if parts and not rest and not _PIECE.fullmatch(parts[-1]) else None
        if odd is not None:
            rest = parts.pop()
        tags = self.tags
        for text, source in zip(parts[::2], parts[1::2]):
            yield text, tags[source] if source in tags else self.say(source)
        if odd is not None:
            at = len(page) - len(odd)
            for start, end, name, closing, attributes in pieces(page, at):
                yield rest + page[at:start], _said(name, closing, attributes)
                at, rest = end, ""
            rest += page[at:]
        # a tag that the page's end cuts off is no text
        cut = rest.rfind("<")
        yield rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]|<$", rest[cut:]) else rest, _END

    def read(self, page: str) -> tuple[list[str], list[Block], bool]:
        """The page's tokens and blocks as in read(), and if it has tokens at all."""
        if self.chars > _PATHS:
            self.top, self.chars = _Holder("", "", False, False, None), 0
        wanted, holder = self.wanted, self.top
        tokens: list[str] = []
        blocks: list[Block] = []
        text: list[str] = []
        link, in_link, some = 0, 0, False

        def close() -> None:
            joined = html.unescape(text[0] if len(text) == 1 else "".join(text))
            text.clear()
            # the only white space that is printable is a blank
            joined = joined.strip() if joined.isprintable() and "  " not in joined else " ".join(joined.split())
            if joined:
                path = holder.path
                blocks.append(Block(path, holder.apart, holder.inside, min(1.0, link / len(joined)) if link else 0.0, joined, len(tokens)))
                token = f"{path} \0{joined}"
                if wanted is None:
                    tokens.append(token)
                    tokens.extend([f"{path} {w}" for w in joined.split(" ")])
                else:
                    if token in wanted:
                        tokens.append(token)
                    own, begins = self.words.get(path, _NONE)
                    if any(c in joined for c in begins):
                        tokens.extend([f"{path} {w}" for w in joined.split(" ") if w in own])

        for piece, said in self.tags_of(page):
            if piece:
                text.append(piece)
                if in_link and said != _END:
                    link += len(piece)
            if said.__class__ is not int:
                some = True
                if text:
                    close()
                link = 0
                token, holder = holder.moves.get(said) or self.move(holder, said)
                if token is not None:
                    tokens.append(token)
            elif said == _LINK:
                in_link += 1
            elif said == _UNLINK:
                in_link = max(0, in_link - 1)
            elif said == _SPACE:
                text.append(" ")
        close()
        return tokens, blocks, some or bool(blocks)


def read(page: str) -> tuple[list[str], list[Block]]:
    """The page's tokens (tags with the holders around them, blocks, and their words), and its text blocks; blocks know how many tokens are before them."""
    return _Reader().read(page)[:2]


@dataclass
class Template:
    root: dict[str, int]  # tokens that stand once in nearly all pages, by their place in order
    slots: dict[tuple[int, str], bool]  # (slot, path): if its text is content; for what half of the pages have
    texts: frozenset[str]  # blocks of articles that are the template's


#: A page that a template is deduced from: a hash of it, its tokens, its blocks.
Page = tuple[int, list[str], list[Block]]
#: Pages with the tokens named, or all, each read as it is asked for.
Pages = Callable[[frozenset[str] | None], Iterable[Page]]


def hashed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def nearly_all(k: int, n: int) -> bool:
    return 10 * k >= 9 * n


def article(blocks: list[Block]) -> dict[str, int]:
    """The text tokens of a page's article with their lengths."""
    return {text_token(b): len(b.text) for b in blocks if b.inside and not b.apart}


def survey(look: Pages) -> Iterator[dict]:
    """First look at some of a host's pages: tokens that half of them have, and the blocks of each article.

    What half of all pages have, half of the pages of some group have, so no
    such token is missed. Text tokens inside articles count among pages with an
    article alone."""
    counts: Counter[str] = Counter()
    inside: set[str] = set()
    n, articles = 0, 0
    for sig, tokens, blocks in look(None):
        counts.update(set(tokens))
        n += 1
        articles += any(b.inside for b in blocks)
        inside.update([text_token(b) for b in blocks if b.inside and b.apart])
        own = article(blocks)
        inside.update(own)
        for token, chars in own.items():
            yield {"key": hashed(token), "sig": sig, "n": chars}
    for token, k in counts.items():
        if 2 * k >= (articles if token in inside else n):
            yield {"token": token, "key": 0}


def count(look: Pages, notes: list[dict]) -> Iterator[dict]:
    """Second look: occurrence vectors of the tokens found, as digests, and the pages that say something new of an article.

    Near copies say no more about a template than copies: a page counts among
    articles if over half of its article's characters are in blocks that no
    page before it (by hash) has."""
    wanted = frozenset(r["token"] for r in notes if r["token"] is not None)
    owned: Counter[int] = Counter()
    for r in notes:
        if r["token"] is None:
            owned[r["sig"]] += r["n"]
    stats = {t: [0, 0, 0, 0, 0] for t in wanted}
    pages, articles, inside = 0, 0, set()
    for sig, tokens, blocks in look(wanted):
        pages += 1
        tokens = [t for t in tokens if t in wanted]
        times = Counter(tokens)
        first = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1)))
        digests = {c: hashed(f"{sig} {c}") for c in set(times.values())}
        for t, c in times.items():
            s = stats[t]
            s[0] += 1
            s[1] += c
            s[2] += c == 1
            s[3] ^= digests[c]
            s[4] += (first[t] << 20) // len(tokens)
        articles += any(b.inside for b in blocks)
        inside.update([text_token(b) for b in blocks if b.inside and b.apart])
        own = article(blocks)
        inside.update(own.keys() & wanted)
        if 2 * owned[sig] > sum(own.values()):
            yield {"sig": sig}
    for t, (n, total, once, digest, at) in stats.items():
        if n:
            yield {"token": t, "n": n, "total": total, "once": once, "digest": digest, "at": at, "inside": int(t in inside)}
    yield {"token": "", "n": pages, "total": articles, "once": 0, "digest": 0, "at": 0}


def in_turn(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (token's index, root place) whose places rise: what stands out of order in a page is no mark there."""
    if all(a[1] < b[1] for a, b in zip(places, places[1:])):
        return places
    ends: list[int] = []  # root places that end the best runs of each length
    at: list[int] = []
    before = [-1] * len(places)
    for i, (_, place) in enumerate(places):
        k = bisect.bisect_left(ends, place)
        before[i] = at[k - 1] if k else -1
        ends[k:], at[k:] = [place, *ends[k + 1 :]], [i, *at[k + 1 :]]
    out, i = [], at[-1]
    while i >= 0:
        out.append(places[i])
        i = before[i]
    return out[::-1]


def gaps(root: dict[str, int], tokens: list[str], wanted: Iterable[int]) -> list[int]:
    """The slot of each wanted index of tokens: one more than the last root token before it. A page that lacks a root token keeps the numbers of the others."""
    first: dict[str, int] = {}
    for i, t in enumerate(tokens):
        if t in root:
            first.setdefault(t, i)
    marks = in_turn([(i, root[t]) for t, i in first.items()])
    index = [i for i, _ in marks]
    return [marks[k - 1][1] + 1 if (k := bisect.bisect_left(index, i)) else 0 for i in wanted]


def describe(look: Pages, notes: list[dict]) -> Iterator[dict]:
    """Third look: the root and, for each slot and class, what these pages say of it."""
    total = next((r for r in notes if r["token"] == ""), {"n": 0, "total": 0})
    n, articles = total["n"], total["total"]
    alone = {r["sig"] for r in notes if r["token"] is None}
    found = [r for r in notes if r["token"] and 2 * r["n"] >= (articles if r["inside"] else n)]
    once = sorted((r for r in found if n > 1 and nearly_all(r["once"], n)), key=lambda r: (r["at"] / r["n"], r["token"]))
    root = {r["token"]: i for i, r in enumerate(once)}
    for token, i in root.items():
        yield {"kind": "root", "name": token, "place": i, "n": 0}
    # tokens of equal vectors are a class; one that repeats is nested in a slot, its tokens in turn
    members: dict[tuple[int, int, int], list[str]] = defaultdict(list)
    for r in found:
        if r["total"] > r["n"]:
            members[r["digest"], r["n"], r["total"]].append(r["token"])
    owner = {t: min(ts) for ts in members.values() if len(ts) > 1 for t in ts}
    size = Counter(owner.values())
    known = {r["token"] for r in found}
    pages, singles = 0, 0
    common: Counter[str] = Counter()
    slots: dict[tuple[int, str], dict] = {}
    nested: dict[str, dict] = {}
    for sig, tokens, blocks in look(frozenset(root) | owner.keys()):
        pages += 1
        singles += sig in alone
        turns: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(tokens):
            if t in owner:
                turns[owner[t]].append(i)
        for name, at in turns.items():
            held = gaps(root, tokens, [at[0], at[-1]])
            seq = [tokens[i] for i in at]
            turn = seq[: size[name]]
            valid = seq == turn * (len(seq) // len(turn))
            text = hashed("\1".join(turn))
            r = nested.setdefault(name, {"kind": "class", "name": name, "n": 0, "broken": 0, "low": held[0], "high": held[1], "least": text, "most": text})
            r |= {"broken": r["broken"] + (not valid), "low": min(r["low"], held[0]), "high": max(r["high"], held[1]), "least": min(r["least"], text), "most": max(r["most"], text)}
        if sig in alone:
            common.update({text_token(b) for b in blocks if b.inside} & known)
        here: dict[tuple[int, str], list[Block]] = defaultdict(list)
        for b, place in zip(blocks, gaps(root, tokens, [b.at for b in blocks])):
            here[place, b.path].append(b)
        for (place, path), bs in here.items():
            if (r := slots.get((place, path))) is None:
                r = slots[place, path] = {"kind": "slot", "name": path, "place": place, "n": 0, "k": 0, "chars": 0, "linked": 0, "least": None, "most": None, "of": articles if bs[0].inside else n, "inside": int(bs[0].inside)}
            r["n"] += 1
            r["chars"] += sum(len(b.text) for b in bs)
            r["linked"] += sum(round(len(b.text) * b.linked) for b in bs)
            if sig in alone or not bs[0].inside:
                text = hashed("\1".join(b.text for b in bs))
                r["k"] += 1
                r["least"] = text if r["least"] is None else min(r["least"], text)
                r["most"] = text if r["most"] is None else max(r["most"], text)
    yield from nested.values()
    yield from slots.values()
    for token, k in common.items():
        yield {"kind": "text", "name": token, "group": owner.get(token), "n": 0, "k": k}
    yield {"kind": "pages", "name": "", "n": pages, "k": singles}


def decided(notes: list[dict]) -> Template:
    """The template of a host from what all its pages said."""
    total = next((r for r in notes if r["kind"] == "pages"), {"n": 0, "k": 0})
    n, alone = total["n"], total["k"]
    valid = {r["name"] for r in notes if r["kind"] == "class" and not r["broken"] and r["low"] == r["high"] and r["least"] == r["most"]}
    # an article's block is the template's if it stands in nearly all articles, or in half of them as part of a class that repeats
    texts = frozenset(r["name"] for r in notes if r["kind"] == "text" and r["k"] >= 3 and (nearly_all(r["k"], alone) or (r["group"] in valid and 2 * r["k"] >= alone)))
    slots = {}
    for r in notes:
        if r["kind"] == "slot":
            inside = bool(r["inside"])
            constant = r["k"] >= 3 and 2 * r["k"] >= (alone if inside else n) and r["least"] == r["most"]
            slots[r["place"], r["name"]] = not constant and (inside or r["linked"] < 0.6 * r["chars"])
    return Template({r["name"]: r["place"] for r in notes if r["kind"] == "root"}, slots, texts)


def deduce(pages: list[tuple[list[str], list[Block]]]) -> Template:
    """The template of pages in memory: the three looks at one group. Equal pages count once, and pages without tokens not at all."""
    own = [(i, t, b) for i, (t, b) in enumerate({tuple(t): (t, b) for t, b in pages if t}.values())]
    first: dict[tuple, dict] = {}
    look = lambda _: own
    for r in survey(look):
        key = (r.get("token"), r["key"])
        first[key] = min(first.get(key, r), r, key=lambda r: r.get("sig", 0))
    notes = list(count(look, [{"token": None, "sig": None, "n": None} | r for r in first.values()]))
    notes = list(describe(look, [{"token": None} | r for r in notes]))
    return decided([r for r in notes if r["kind"] != "slot" or 2 * r["n"] >= r["of"]])


def main_text(template: Template, tokens: list[str], blocks: list[Block]) -> str:
    """Blocks of the page's content slots, in order; where the page has an article, of those inside it. Slots that the template doesn't know are judged by the page."""
    slots = list(zip(gaps(template.root, tokens, [b.at for b in blocks]), [b.path for b in blocks]))
    chars: Counter[tuple[int, str]] = Counter()
    linked: Counter[tuple[int, str]] = Counter()
    for slot, b in zip(slots, blocks):
        chars[slot] += len(b.text)
        linked[slot] += round(len(b.text) * b.linked)
    content = [template.slots.get(s, b.inside or linked[s] < 0.6 * chars[s]) and not b.apart and not (b.inside and text_token(b) in template.texts) for s, b in zip(slots, blocks)]
    kept = [b for b, ok in zip(blocks, content) if ok]
    if any(b.inside for b in kept):
        kept = [b for b in kept if b.inside]
    return " ".join(b.text for b in kept)


def _pages(group: pa.Table, wanted: frozenset[str] | None) -> Iterator[Page]:
    """Pages of a group that a template is deduced from: each html once, none without tokens."""
    own = {s: h for s, h, lead in zip(group.column("sig").to_pylist(), group.column("html").to_pylist(), group.column("lead").to_pylist()) if lead}
    reader = _Reader(wanted)
    for s, h in sorted(own.items()):
        tokens, blocks, some = reader.read(h)
        if some:
            yield s, tokens, blocks


def _table(rows: Iterable[dict], group: pa.Table, schema: pa.Schema) -> pa.Table:
    """rows with the group's keys, as a table."""
    keys = {k: group.column(k)[0].as_py() for k in _KEYS} if len(group) else {}
    rows = list(rows) if keys else []
    return pa.table([pa.repeat(pa.scalar(keys[f.name], f.type), len(rows)) if f.name in keys else pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema)


#: What tells a group of a host: its host, its number, and how many the host has.
_KEYS = ("hid", "part", "parts")


def _schema(strings: str, longs: str) -> pa.Schema:
    return pa.schema([(k, pa.int64()) for k in _KEYS] + [(c, pa.string()) for c in strings.split()] + [(c, pa.int64()) for c in longs.split()])


_SURVEY = _schema("token", "key sig n")
_COUNT = _schema("token", "sig n total once digest at inside")
_DESCRIBE = _schema("kind name group", "place n k of inside broken low high least most chars linked")


def _spark(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'long'}" for f in schema)


def host_templates(dealt: DataFrame) -> DataFrame:
    """hid, part and rows that say the template of each host, for each of its groups; dealt is shuffled by hid and part once, and read in each look.

    Each look sends on rows for what half of a group's pages have, or a row for
    each block of an article; a host's rows are partial aggregates over its
    groups. No task has more of a host than one group and a template, which is
    bounded by twice a mean page."""
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)

    def to_groups(rows: DataFrame, one: Column) -> DataFrame:
        """A token's row to all groups of its host, a page's to its own."""
        return rows.withColumn("part", F.explode(F.when(F.col("token").isNotNull(), everywhere).otherwise(F.array(one))))

    def look(step, schema: pa.Schema, notes: DataFrame | None = None) -> DataFrame:
        if notes is None:
            return dealt.groupBy("hid", "part").applyInArrow(lambda group: _table(step(partial(_pages, group)), group, schema), _spark(schema))
        both = dealt.groupBy("hid", "part").cogroup(notes.groupBy("hid", "part"))
        return both.applyInArrow(lambda group, notes: _table(step(partial(_pages, group), notes.to_pylist()), group, schema), _spark(schema))

    first = look(survey, _SURVEY).groupBy("hid", "token", "key").agg(F.min(F.struct("sig", "part", "n")).alias("first"), F.max("parts").alias("parts"))
    first = to_groups(first, F.col("first.part")).select("hid", "part", "token", "first.sig", "first.n")
    second = look(count, _COUNT, first).groupBy("hid", "token", "sig").agg(*[F.sum(c).alias(c) for c in ("n", "total", "once", "at")], F.bit_xor("digest").alias("digest"), F.max("inside").alias("inside"), F.min("part").alias("own"), F.max("parts").alias("parts"))
    second = to_groups(second, F.col("own")).select("hid", "part", "token", "sig", "n", "total", "once", "at", "digest", "inside")
    third = look(describe, _DESCRIBE, second).groupBy("hid", "kind", "name", "group", "place")
    third = third.agg(*[F.sum(c).alias(c) for c in ("n", "k", "broken", "chars", "linked")], *[F.min(c).alias(c) for c in ("low", "least")], *[F.max(c).alias(c) for c in ("of", "inside", "high", "most", "parts")])
    return third.where("kind != 'slot' or 2 * n >= of").withColumn("part", F.explode(everywhere)).drop("parts", "of")


def dealt_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, group_pages: int) -> DataFrame:
    """page_id, url, html, hid (hash of the host), sig (hash of the html), lead (if the row speaks for its html), part, parts.

    A host of more than group_pages pages is dealt to parts by sig, so equal
    pages meet; an html whose copies on a host have more than HOT_BYTES is
    dealt by page, and its smallest row speaks for it. Such htmls are
    broadcast: they are fewer than the table's bytes over HOT_BYTES."""
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    shaped = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.xxhash64(host).alias("hid"))
    shaped = shaped.withColumn("sig", F.xxhash64("html"))
    row = F.xxhash64("page_id", "url")
    large = shaped.groupBy("hid").agg(F.count("*").alias("n")).where(F.col("n") > group_pages).select("hid", F.ceil(F.col("n") / group_pages).cast("long").alias("parts"))
    hot = shaped.groupBy("hid", "sig").agg(F.sum(F.octet_length("html")).alias("bytes"), F.min(row).alias("speaker")).where(F.col("bytes") > HOT_BYTES).drop("bytes")
    # tables of their own, so that their sizes are known before pages are joined
    dealt = shaped.join(written(large, "large-hosts"), "hid", "left").join(F.broadcast(written(hot, "hot-pages")), ["hid", "sig"], "left")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = dealt.select("page_id", "url", "html", "hid", "sig", F.coalesce(F.col("speaker") == row, F.lit(True)).alias("lead"), F.pmod(F.when(F.col("speaker").isNull(), F.col("sig")).otherwise(row), parts).alias("part"), parts.alias("parts"))
    return dealt.repartition("hid", "part")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """Per row: page_id, url, text ('' if none), n_chars.

    A host has one template, whatever its size; group_pages says only how its
    pages are dealt to tasks and changes no result. A page alone in its host,
    or without a host, is judged by its own elements. Null html is empty. Equal
    pages of a host get equal texts; rows with a null or repeated page_id come
    back as often."""
    dealt = dealt_pages(pages, id_col, url_col, html_col, group_pages)

    def extracted(group: pa.Table, notes: pa.Table) -> pa.Table:
        template = decided(notes.to_pylist())
        reader = _Reader(frozenset(template.root))
        texts = [main_text(template, *reader.read(x.as_py())[:2]) for x in group.column("html")]
        columns = [group.column("page_id"), group.column("url")] if len(group) else [pa.array([], pa.int64()), pa.array([], pa.string())]
        return pa.table([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    both = dealt.groupBy("hid", "part").cogroup(host_templates(dealt).groupBy("hid", "part"))
    return both.applyInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() of all pages; an empty table gives no rows."""
    return extract(table(spark, sf_dir, "pages"))
