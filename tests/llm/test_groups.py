"""Operators that bring rows together, beside brute force."""

import base64
import gzip
import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tabulon.llm import components, decontamination, html_text, simhash, suffixes, warc

from . import odd


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5)]
    s = Sets()
    for a, b in links:
        s.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links + links[:20], "a long, b long")).collect()}
    assert all(got.get(n, n) == s.find(n) for n in s.up)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    data = odd.rows()
    prints = [fingerprint(t) for _, t in data]
    s = Sets()
    for i, (a, _) in enumerate(data):
        for j, (b, _) in enumerate(data[:i]):
            if a is not None and b is not None and (prints[i] ^ prints[j]).bit_count() <= 3:
                s.join(a, b)
    got = Counter((r.doc_id, r.fingerprint) for r in simhash.near_duplicates(odd.documents(spark)).collect())
    assert got == Counter((k, f"{p:016x}") for (k, _), p in zip(data, prints, strict=True))
    for r in simhash.near_duplicates(odd.documents(spark)).collect():
        if r.doc_id is not None:
            assert r.component_id == s.find(r.doc_id)
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0


def test_links_connect_all_that_is_near(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    flips = lambda n: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) if n else np.uint64(0)
    fps = sorted({int(b ^ flips(k)) for b in base for k in (0, 1, 2, 3, 4, 5, 6)} | {int(base[0] ^ flips(2)) for _ in range(200)})
    s, own = Sets(), Sets()
    for i, a in enumerate(fps):
        s.find(i), own.find(i)
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                s.join(i, j)
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    links = simhash.near_links(df).collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 for r in links)
    for r in links:
        own.join(r.a, r.b)
    assert [own.find(k) for k in range(len(fps))] == [s.find(k) for k in range(len(fps))]
    assert len(links) < len(fps) * 20  # a forest for each kind of cell, not all pairs


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    near = np.abs(simhash.bit_counts(a).astype(int) - simhash.bit_counts(b)).sum(axis=1)
    assert (near <= np.bitwise_count(a ^ b)).all()


def removed(rows):
    """Brute force of repeated strings: by doc_id, null below all."""
    order = lambda k: -(1 << 63) if k is None else k
    first = {}
    for k, b in rows:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 63), order(k))
    out = []
    for k, b in rows:
        mask = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(k):
                mask[i : i + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(mask)))
        out.append((k, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return Counter(out)


def test_suffixes(spark, monkeypatch):
    data = [(k, (t or "").encode()) for k, t in odd.rows() if len(t or "") < 50_000]
    df = odd.documents(spark, [(k, t) for k, t in odd.rows() if len(t or "") < 50_000])
    want = removed(data)
    for size, hot in ((8 << 20, 512), (3000, 512), (3000, 2), (3000, 0)):
        monkeypatch.setattr(suffixes, "GROUP_BYTES", size)
        monkeypatch.setattr(suffixes, "HOT_GROUPS", hot)
        got = suffixes.remove_repeats(df, with_text=True, carry=("source",))
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert suffixes.remove_repeats(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_of_few_letters(spark, monkeypatch, seed):
    """Texts of two letters and of copied pieces: many ties, repeats within and between documents."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab" if seed % 2 else "abcdefgh é") for _ in range(rng.randint(20, 160))) for _ in range(12)]
    data = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))) for k in range(50)] + [(50, "a" * 300), (51, "a" * 70), (52, "ba" * 90)]
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 4000)
    monkeypatch.setattr(suffixes, "HOT_GROUPS", (512, 1)[seed // 2])
    got = suffixes.remove_repeats(odd.documents(spark, data))
    assert Counter(tuple(r) for r in got.collect()) == removed([(k, t.encode()) for k, t in data])


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (400, 6)).astype(np.uint64)
    order, differs = suffixes.multikey_order(rows)
    assert rows[order].tolist() == sorted(rows.tolist())
    for k in range(1, 400):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert differs[k] == next((c for c in range(6) if a[c] != b[c]), 6)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, odd.prose(rng, rng.randint(6, 40))) for k in range(25)] + [(100, "two words"), (101, ""), (102, None), (103, items_text := odd.prose(rng, 30)), (104, items_text)]
    data = list(odd.rows())
    for n in range(120):
        w = rng.choice([t for _, t in items if t]).split()
        for _ in range(rng.randint(0, 3)):
            k = rng.choice([0, 1, len(w) - 1, rng.randrange(len(w))])
            w[k : k + 1] = rng.choice([["zz"], [w[k], "yy"], []])
            w = w or ["q"]
        data.append((1000 + n, f"{odd.prose(rng, rng.randint(0, 20))}\n{' '.join(w)}, {odd.prose(rng, 5)}"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w, n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    want = Counter()
    for doc, text in data:
        w = words(text or "")
        for item, t in items:
            i = words(t or "")
            if not i:
                continue
            if len(i) < 5:
                at = [k for k, g in enumerate(grams(w, len(i))) if g == tuple(i)]
                if at:
                    want[doc, item, 1.0, at[0], len(i)] += 1
                continue
            own, m, best = Counter(grams(i, 5)), min(len(i), len(w)) - 4, None
            g = grams(w, 5)
            for k in range(len(g) - m + 1 if m > 0 else 0):
                c = Counter(g[k : k + m])
                both = sum((c & own).values())
                s = both / (c.total() + own.total() - both)
                if s >= 0.8 and (best is None or s > best[0]):
                    best = (s, k)
            if best:
                want[doc, item, round(best[0], 9), best[1], m + 4] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in decontamination.contaminated(odd.documents(spark, data), bench).collect())
    assert got == want and len(want) > 60
    # what the blocks of fingerprints find by themselves, and what is left to the way beyond them
    alone = {(r.doc_id, r.item_id) for r in decontamination.contaminated(odd.documents(spark, data), bench, beyond=False).collect()}
    every, short = {(d, i) for d, i, *_ in want}, {k for k, t in items if t and len(words(t)) < 5}
    assert 0.9 <= len({x for x in every & alone if x[1] not in short}) / len({x for x in every if x[1] not in short}) and alone <= every
    assert decontamination.contaminated(odd.empty(spark), bench).count() == 0
    assert decontamination.contaminated(odd.documents(spark), bench.limit(0)).count() == 0


def test_blocks_of_fingerprints_name_candidates():
    rng = random.Random(4)
    item = odd.prose(rng, 100)
    changed = item.split()
    changed[50] = "zzz"
    ix = decontamination.index([(7, item)])
    raw = np.frombuffer(f"{odd.prose(rng, 9)} {' '.join(changed)} {odd.prose(rng, 9)}".encode(), np.uint8)
    words, _ = decontamination.words_of(raw, np.array([0, len(raw)]))
    both = list(decontamination.found_in(ix, len(words), [0], [words]))
    assert both == list(decontamination.found_in(ix, len(words), [0], [words], beyond=False)) and both[0][0] == 7
    ix.tables = {size: [{} for _ in tables] for size, tables in ix.tables.items()}
    assert not list(decontamination.found_in(ix, len(words), [0], [words], beyond=False))
    assert both == list(decontamination.found_in(ix, len(words), [0], [words]))


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = Counter(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 2000)
    assert Counter(map(tuple, decontamination.contaminated(docs, bench).collect())) == whole


def test_warc(spark, tmp_path):
    pages = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (3, "u", ""), (4, "u", None), (7, "é", "é\r\n\r\nWARC/1.1\r\n" * 3), (None, "n", "same"), (8, "u", "x" * 200_000), (2, "http://again/", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_roundtrip(df, f"file://{tmp_path}/w").collect())
    want = Counter()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for k, _, t in pages:
        if k is not None:
            first[digest(t)] = min(first.get(digest(t), k), k)
    for k, _, t in pages:
        again = k is not None and first[digest(t)] != k
        want[k, len((t or "").encode()), digest(t), "revisit" if again else "response", first[digest(t)] if again else None] += 1
    assert got == want
    files = list((tmp_path / "w/resolved").glob("*.gz"))
    assert sum(gzip.open(f).read().count(b"WARC-Type: revisit") for f in files) == 3
    back = warc.read_archives(spark, f"file://{tmp_path}/w/resolved", payload=True).where("page_id = 7").first()
    assert bytes(back.payload).decode() == pages[5][2]
    assert warc.warc_roundtrip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_threshold(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.warc_roundtrip(df, f"file://{tmp_path}/w", least=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def page(rng, host, k, tail="</body></html>"):
    body = [odd.prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
    title = odd.prose(rng, 4)
    html = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='</p><article>';</script></head><body><header><h2>{host}</h2></header><nav><ul><li><a href='/{k}'>link &amp; more</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><!-- {k} <p>no</p> --><article><h1>{title}</h1>" + "".join(f"<p>{b} &amp; <b>bold</b>&nbsp;x" + "</p>" * (k % 2) for b in body)
        + f"</article><section id=comments><p>{odd.prose(rng, 9)}</p></section><aside>{odd.prose(rng, 5)}</aside><form><label>Name</label></form><footer>&copy; {host}</footer>{tail}"
    )
    return html, " ".join([title, *(f"{b} & bold x" for b in body)])


def test_html(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        host = "big.example" if k < 40 else f"h{k // 6}.example"
        html, text = page(rng, host, k, "" if k % 7 == 0 else "</body></html>")
        rows.append((k, f"https://{host}/{k}", html))
        want[k] = text
    rows += [(100, None, rows[0][2]), (101, "https://big.example/copy", rows[1][2]), (102, "x", None), (103, "http://e/", ""), (104, "http://e/", "plain text only"), (105, "http://e/", "<p>a &lt;b&gt; c<p>d  e"), (106, "http://e/", "<div><p>cut <a href='")]
    want |= {100: want[0], 101: want[1], 102: "", 103: "", 104: "plain text only", 105: "a <b> c d e", 106: "cut"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (150, 10):
        got = {r.page_id: r for r in html_text.extract(df, group_pages=group).collect()}
        assert {k: r.text for k, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_names_of_holders(spark):
    rows = [(1, "http://a/1", "<div class=with-sidebar><article><p>kept</p><section class=\"comments\"><article class=\"comment\">not</article></section></article></div><div class=\"sidebar\">no</div>")]
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text == "kept"


def test_template_classes():
    rng = random.Random(12)
    pages = [html_text.read(page(rng, "h", k)[0]) for k in range(12)]
    t = html_text.deduce(pages)
    assert [x.split(" ", 1)[1] for x in t.root if "article" in x] == ["<article >", "<h1>", "</h1>", "</article>"] or any("</article>" in x for x in t.root)
    assert any(v for v in t.slots.values()) and not all(t.slots.values())


def test_html_template_inside_articles(spark):
    """Boxes of no telling name that a host's articles share are cut, also between paragraphs; near copies aren't taken for a template."""
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(12):
        body = [odd.prose(rng, 30) for _ in range(3)]
        box = "<div class=x1>Read this and that in our app</div>" if k != 5 else ""
        rows.append((k, f"http://a/{k}", f"<body><article><h1>t{k}</h1>{box}" + "".join(f"<p>{b}</p><p>Tap to see the picture</p>" for b in body) + "<p>Sent to you by the house</p></article></body>"))
        want[k] = " ".join([f"t{k}", *body])
    same = [odd.prose(rng, 30) for _ in range(5)]
    for k in range(20, 24):
        rows.append((k, f"http://b/{k}", "<body><article>" + "".join(f"<p>{b}</p>" for b in [*same, f"ends {k}"]) + "</article></body>"))
        want[k] = " ".join([*same, f"ends {k}"])
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_root_survives_odd_pages():
    """Null, empty and differently laid out pages don't empty the template."""
    rng = random.Random(14)
    pages = [f"<body><div><p>Top of all pages</p></div><ul><li>{odd.prose(rng, 12)}</li></ul></body>" for _ in range(30)]
    plain = html_text.deduce([html_text.read(p) for p in pages])
    mixed = html_text.deduce([html_text.read(p) for p in [*pages, "", "", "<table><tr><td>other</td></tr></table>"]])
    assert plain.root and list(mixed.root) == list(plain.root)
    t, b = html_text.read("<body><div><p>" + "word " * 100 + "</p></div></body>")
    assert sum(x.endswith(" word") for x in t) >= 100


def test_html_one_template_a_host(spark, monkeypatch):
    """A box in about nine of ten articles gets one verdict for the whole host, however its pages are dealt; copies, also very many, change nothing."""
    rng = random.Random(15)
    for share, cut in ((285, True), (255, False)):
        rows = []
        for k in range(300):
            box = "<p>Read this and that in our app</p>" if k % 300 < share else ""
            rows.append((k, f"http://a/{k}", f"<body><div><p>Top of all</p></div><article><h1>t{k}</h1><p>{odd.prose(rng, 30)}</p>{box}<p>{odd.prose(rng, 20)}</p></article></body>"))
        near = rows[0][2].replace("</article>", "<p>ends {}</p></article>")
        rows += [(1000 + k, f"http://a/{k}", near.format(k)) for k in range(90)] + [(2000 + k, f"http://a/c{k}", rows[1][2]) for k in range(60)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        want = {}
        template = html_text.deduce([html_text.read(h) for _, _, h in rows])
        for k, _, h in rows:
            want[k] = html_text.main_text(template, *html_text.read(h))
        assert ("in our app" not in want[0]) == cut and "Top of all" not in want[0]
        for group, hot in ((1000, 32 << 20), (40, 32 << 20), (40, 2000)):
            monkeypatch.setattr(html_text, "HOT_BYTES", hot)
            assert {r.page_id: r.text for r in html_text.extract(df, group_pages=group).collect()} == want


def test_html_order_of_marks():
    """What stands out of order in a page is no mark of a slot there."""
    assert html_text.in_turn([(0, 0), (4, 3), (5, 1), (9, 2), (11, 4)]) == [(0, 0), (5, 1), (9, 2), (11, 4)]
    assert html_text.in_turn([]) == [] and html_text.in_turn([(3, 1)]) == [(3, 1)]
    assert html_text.gaps({"a": 0, "b": 1}, ["x", "a", "y", "b", "b", "z"], [0, 1, 2, 5]) == [0, 0, 1, 2]


def test_html_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    import html as refs

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_text.op3_html_text(spark, sf).collect()}
    for k, h in pages.items():
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        assert got[k] == " ".join(refs.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_components_of_a_star(spark):
    """A third of all links at one node."""
    links = [(0, k) for k in range(1, 3000)] + [(k, k + 5000) for k in range(2000, 6000)]
    s = Sets()
    for a, b in links:
        s.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == s.find(n) for n in s.up)
    sizes = defaultdict(int)
    for c in got.values():
        sizes[c] += 1
    assert sizes[0] == sum(s.find(n) == 0 for n in s.up)


def test_warc_revisits_in_the_source(spark, tmp_path):
    """A given revisit never becomes a response; one without an original stays as it is; foreign archives lack the X- headers."""
    record = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:{}>\r\nWARC-Date: 2001-01-01T00:00:00Z\r\nWARC-Target-URI: http://x/\r\nWARC-Payload-Digest: sha1:{}\r\n{}Content-Length: {}\r\n\r\n{}"
    pages = lambda k: f"X-Page-Id: {k}\r\nX-Payload-Length: 4\r\n"
    given = [
        record.format("revisit", "r1", "AAAA", pages(1) + "WARC-Refers-To: <urn:uuid:gone>\r\nX-Refers-To-Page: 77\r\n", 0, ""),
        record.format("response", "r5", "AAAA", pages(5), 4, "body"),
        record.format("response", "r9", "AAAA", pages(9), 4, "body"),
        record.format("revisit", "r2", "BBBB", pages(2) + "WARC-Refers-To: <urn:uuid:gone>\r\nX-Refers-To-Page: 77\r\n", 0, ""),
        record.format("response", "f1", "CCCC", "", 11, "a\r\n\r\nb\r\n\r\nc"),
    ]
    warc.write_archives(spark.createDataFrame([(x,) for x in given], "value string").coalesce(1), f"file://{tmp_path}/in")
    warc.resolve(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = {(r.page_id, r.payload_digest): r for r in warc.read_archives(spark, f"file://{tmp_path}/out", payload=True).collect()}
    kinds = {k: (r.record_type, r.refers_to, bytes(r.payload)) for k, r in got.items()}
    assert kinds == {
        (1, "AAAA"): ("revisit", 5, b""), (5, "AAAA"): ("response", None, b"body"), (9, "AAAA"): ("revisit", 5, b""),
        (2, "BBBB"): ("revisit", 77, b""), (None, "CCCC"): ("response", None, b"a\r\n\r\nb\r\n\r\nc"),
    }
    assert got[9, "AAAA"].refers_record == got[5, "AAAA"].record_id and got[2, "BBBB"].refers_record == "gone"
    assert not {r.record_id for r in got.values()} & {"r1", "r5", "r9", "r2", "f1"}
    text = "".join(gzip.open(f, "rt", newline="").read() for f in (tmp_path / "out").glob("*.gz"))
    assert "2001-01-01" not in text


def test_warc_hot_and_long_payloads(spark, tmp_path):
    """A third of all rows share a payload; pages of some megabytes; columns with clashing names."""
    pages = [(k, "u", "same" if k % 3 == 0 else f"own {k}") for k in range(900)] + [(1000, "u", "\r\n\r\n" * 400_000), (1001, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: warc.F.lit("clash") for c in ("record_id", "fresh", "body", "n", "first", "payload_digest")})
    got = {r.page_id: r for r in warc.warc_roundtrip(df, f"file://{tmp_path}/w").collect()}
    assert len(got) == len(pages) and all((r.record_type, r.refers_to) == (("revisit", 0) if k and k < 900 and k % 3 == 0 else ("response", None)) for k, r in got.items())
    assert got[1000].payload_bytes == 1_600_000 and got[1001].payload_bytes == 3_000_000


def test_warc_line_ends(spark, tmp_path):
    """Payloads of carriage returns and line feeds in any order, also at their ends."""
    rng = random.Random(23)
    pages = [(k, "u", "".join(rng.choice(["\r", "\n", "\r\n", "x", "\r\n\r\n"]) for _ in range(rng.randint(0, 12)))) for k in range(600)]
    warc.warc_roundtrip(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, f"file://{tmp_path}/w/fetched", payload=True).collect()}
    assert back == {k: t for k, _, t in pages}


def test_html_tags_in_one_pass(spark):
    """Unclosed tags and quotes take no longer than their length; all of a very long page is read."""
    import time

    for page in ("<script " * 4000, "<a '" * 8000, '<a ">" ' * 6001, "<" * 30_000, "<!-- " * 6000, "<p x='" + '"' * 30_000, "<![" * 10_000 + ">"):
        began = time.process_time()
        html_text.read(page)
        assert time.process_time() - began < 0.1
    text = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, "http://a/", f"<article><p>{text}</p></article>"), (None, "http://a/", "<p>x"), (None, "http://a/", "<p>x"), (2, "http://b/", "<p title='a > b'>kept</p><p title='open>after</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: warc.F.lit("clash") for c in ("host", "part", "text", "n_chars", "n", "groups")})
    got = Counter((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got == Counter({(1, text): 1, (None, "x"): 2, (2, "kept after"): 1})


def test_html_regular_pages_are_read_fast(monkeypatch):
    """A regular page takes few calls a tag in each look; what is read is what pieces() gives, also where a page is not regular."""
    page = "<html><body class='a b'><ul>" + '<li class="x"><a href="/{0}">w{0}</a></li><p>some &amp; text<br></p>' * 200 + "</ul></body></html>"
    page = "".join(p + str(k % 9) for k, p in enumerate(page.split("{0}")))
    calls = Counter()
    for _ in range(2):
        calls.clear()
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            html_text.read(page)
        finally:
            sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 9 * page.count("<")
    rng = random.Random(31)
    bits = "< > <p> </p> </div> <a> </a> <br/> <!-- --> ---> <!--> <!x> <?y ?> <script> </ScRipt\t> </\u017fcript> <\u017fcript> <textarea <title\tx> </title> <svg/> </svg> \" ' &lt;p&gt; & \0 </ </> <1 <p:x> <P\tCLASS=X> w \u00e9 \u00a0 <scripts> <article> </article> <header\trole=banner> </header> <ul> </ul> <p/ --".split(" ")
    bits += [" ", "  ", "\n", '<div class="a b">', "<div class='menu'>", '<a href="x>y">', '<SCRIPT src="a>b">', "<section class=a id='b c'>"]
    pages = [page] + ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(8000)]
    monkeypatch.setattr(html_text, "_TAGS", 20)
    monkeypatch.setattr(html_text, "_PATHS", 500)
    wanted = frozenset(rng.sample(sorted({t for p in pages for t in html_text.read(p)[0]}), 400))
    for names in (None, wanted):
        reader = html_text._Reader(names)
        got = [reader.read(p) for p in pages]
        assert len(reader.tags) <= 20
        with monkeypatch.context() as m:
            m.setattr(html_text, "_PIECES", re.compile("(<(?s:.*))"))
            m.setattr(html_text, "_PIECE", re.compile("(?!)"))
            assert got == [html_text._Reader(names).read(p) for p in pages]


def test_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    fps = np.array(sorted({base ^ int(np.bitwise_xor.reduce(1 << rng.integers(0, 20, rng.integers(0, 9)).astype(np.int64), initial=0)) for _ in range(400)}), np.uint64)
    s, own = Sets(), Sets()
    for i in range(len(fps)):
        s.find(i), own.find(i)
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 3:
                s.join(i, j)
    links = simhash.forest(fps, np.arange(len(fps)), 3)
    for a, b in links:
        assert int(fps[a] ^ fps[b]).bit_count() <= 3
        own.join(a, b)
    assert [own.find(k) for k in range(len(fps))] == [s.find(k) for k in range(len(fps))] and len(links) < len(fps)


def test_suffixes_of_very_long_texts(spark, monkeypatch):
    """Texts over 50,000 characters, a third of all rows without an id, a range dealt to several buckets."""
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 60_000)
    monkeypatch.setattr(suffixes, "SPLITTERS", 2)
    rng = random.Random(31)
    long = odd.prose(rng, 20_000)
    data = [(1, long), (2, odd.prose(rng, 3000) + long[40_000:90_000]), (-(1 << 63), long[:300]), (None, long[50:200])] + [(None, odd.prose(rng, 30)) for _ in range(30)] + [(k, odd.prose(rng, 40)) for k in range(10, 60)]
    got = suffixes.remove_repeats(odd.documents(spark, data))
    assert Counter(tuple(r) for r in got.collect()) == removed([(k, t.encode()) for k, t in data])
