"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op10_bpe_codec
from .decontamination import op8_decontamination
from .html_text import op3_html_text
from .language_id import op1_language_id
from .lexical_search import op13_lexical_search
from .licenses import op7_license_scan
from .pii import op12_pii
from .prefix_trie import op11_prefix_trie
from .quality_classifier import op4_quality_classifier
from .quality_rules import RULES, STOP_WORDS, op5_quality_rules
from .simhash import op2_simhash
from .suffixes import op9_suffix_dedup
from .warc import op6_warc

_ALL = (op1_language_id, op2_simhash, op3_html_text, op4_quality_classifier, op5_quality_rules, op6_warc, op7_license_scan, op8_decontamination, op9_suffix_dedup, op10_bpe_codec, op11_prefix_trie, op12_pii, op13_lexical_search)

QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
_BROKEN = " OR ".join(
    f"coalesce({' / '.join(f'cast({x} AS DOUBLE)' if k == 0 else f'nullif({x}, 0)' for k, x in enumerate(r.value.split(' / ')))}, 0) {op} {bound}"
    for r in RULES for op, bound in (("<", r.low), (">", r.high)) if bound is not None
)

_OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, {_LINES} AS ls FROM documents),
win AS (SELECT rid, p, [w[p], w[p + 1], w[p + 2], w[p + 3], w[p + 4]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, range(5) r(k) GROUP BY rid),
m AS (SELECT d.rid, doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  cast(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop,
  len(list_filter(ls, lambda l: regexp_matches(l, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet FROM d LEFT JOIN rep ON rep.rid = d.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_BROKEN}) AS kept FROM b"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
_OP6 = f"""WITH h AS (SELECT page_id, cast(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents), s AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, item_id, term, count(*) AS reps FROM (SELECT iid, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT rid, doc_id, cast(100 - 75 + (75 * len(w) * docs) // cast(terms AS BIGINT) AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
r AS (SELECT iid, item_id, rid, doc_id, cast(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, cast(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""

# CRC-32 bit by bit: each character of the decimal id, then eight shifts
_CRC = "xor(list_reduce(flatten(list_transform(string_split(cast(conv_id AS VARCHAR), ''), lambda c: [cast(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, cast(4294967295 AS BIGINT)), 4294967295)"
_OP11 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, x FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, list(x ORDER BY own, pos) AS xs FROM r GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(p.xs, []) AS xs FROM c LEFT JOIN p USING (conv_id)),
m AS (SELECT conv_id, len(xs) AS size, d AS depth, md5(cast(xs[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(cast(xs[1:d - 1] AS VARCHAR)) END AS parent, CASE WHEN d > 0 THEN len(regexp_extract_all(xs[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM a)),
n AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY ALL),
v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (depth, node)),
s AS (SELECT up.depth, up.node, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens FROM v JOIN m AS up ON up.conv_id = v.conv_id AND up.depth <= v.depth GROUP BY up.depth, up.node)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, cast(v.kids AS BIGINT) AS n_children, cast(s.n_leaves AS BIGINT) AS n_leaves, cast(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, node) LEFT JOIN v AS o ON o.depth = v.depth - 1 AND o.node = v.parent"""

ORACLE = {"op5_quality_rules": _OP5, "op6_warc": _OP6, "op11_prefix_trie": _OP11, "op13_lexical_search": _OP13}
