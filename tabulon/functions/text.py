"""Text functions: span parsers, matching, similarity. All are column functions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One mark for each kind of tag; texts with these control characters lose them.
_OPEN_REASON, _CLOSE_REASON, _OPEN_FINAL, _CLOSE_FINAL = "\x01", "\x02", "\x03", "\x04"
#: What counts as a tag, however it is spelt (fixed values).
_TAG = r"(?iU)<\s*{slash}\s*{name}\w*[^\s<>]*\s*>?"


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def _clean(c: Column) -> Column:
    """Without marks and other tags, white space as single spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, "[\x01-\x04]", " "), r"(?U)<\s*/?\s*\w[^<>]*>?", " "))


def has_debris(c: Column) -> Column:
    return c.rlike(r"(?i)<\s*/?\s*(reason|final)")


def parse_tolerant(text: Column) -> Column:
    """struct<reasoning, final> of a text whose tags may be misspelt, unclosed or absent.

    Tags become single marks, so each span is one match: reasoning from its
    first mark to the next end of reasoning or start of final, final from its
    first mark to its end. Without either, the last sentence is final and what
    is before it reasoning. Null gives two empty strings."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x04]", " ")
    for slash, name, mark in (("/", "reason", _CLOSE_REASON), ("", "reason", _OPEN_REASON), ("/", "final", _CLOSE_FINAL), ("", "final", _OPEN_FINAL)):
        marked = F.regexp_replace(marked, _TAG.format(slash=slash, name=name), mark)
    reasoning = _clean(F.regexp_extract(marked, "^[^\x01]*\x01([^\x02\x03]*)", 1))
    final = _clean(F.regexp_extract(marked, "^[^\x03]*\x03([^\x04]*)", 1))
    whole = _clean(marked)
    sentences = F.split(whole, r"(?<=[.!?]) ")
    none = (reasoning == "") & (final == "")
    return F.struct(
        F.when(none, F.array_join(F.slice(sentences, 1, F.size(sentences) - 1), " ")).otherwise(reasoning).alias("reasoning"),
        F.when(none, F.element_at(sentences, -1)).otherwise(final).alias("final"),
    )


def parse_strict(text: Column) -> Column:
    """struct<reasoning, final, status> of well-formed tags only; an empty span counts as found."""
    t = F.coalesce(text, F.lit(""))
    r, f = r"(?is)<reasoning>(.*?)</reasoning>", r"(?is)<final>(.*?)</final>"
    status = F.when(t.rlike(r) & t.rlike(f), "both").when(t.rlike(r), "reasoning_only").when(t.rlike(f), "final_only").otherwise("none")
    return F.struct(squeeze(F.regexp_extract(t, r, 1)).alias("reasoning"), squeeze(F.regexp_extract(t, f, 1)).alias("final"), status.alias("status"))


def status_of(parsed: Column) -> Column:
    r, f = parsed["reasoning"] != "", parsed["final"] != ""
    return F.when(r & f, "both").when(r, "reasoning_only").when(f, "final_only").otherwise("none")


def tokens(c: Column) -> Column:
    """Lower-cased words between white space, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays, as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of token arrays as sets: the default pair scorer, no learned model."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def set_f1(a: Column, b: Column) -> Column:
    """token_f1 of arrays in which nothing repeats, of which one isn't empty."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def token_recall(answer: Column, final: Column) -> Column:
    own = F.array_distinct(answer)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, final)) / F.size(own))


def plain_match(c: Column) -> Column:
    """Lower-cased, marks as spaces, single spaces; without NFKC (see match_form)."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+", " "))


def nfkc(c: Column) -> Column:
    """The NFKC form, by the engine's own Unicode library; null stays null. Its tables are those of the engine's Unicode version."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def match_form(c: Column) -> Column:
    """The NFKC form lower-cased, all but letters, numbers and _ as single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_]+", " "))


#: White space, with the four separators of ASCII.
_SPACE = r"[\s\x1c-\x1f]"


def _literal(choice: Column) -> Column:
    """A pattern for a choice's words in any case, any white space between them; null where it has no word."""
    words = F.filter(F.split(choice, f"(?U){_SPACE}+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?iuU)"), F.array_join(quoted, f"{_SPACE}+")))


def mask_choices(text: Column, choices: Column) -> Column:
    """struct<masked, matches>: each choice, the longest first, replaced where it stands (any case and white space) in the NFKC form by its placeholder, and which were, as often as they were."""
    form = nfkc(F.coalesce(text, F.lit("")))
    each = F.transform(F.coalesce(choices, F.array().cast("array<string>")), lambda c, k: F.struct((-F.length(nfkc(F.coalesce(c, F.lit(""))))).alias("order"), k.alias("k"), _literal(nfkc(F.coalesce(c, F.lit("")))).alias("pattern")))
    ordered = F.array_sort(F.filter(each, lambda x: x["pattern"].isNotNull()))

    def step(done: Column, x: Column) -> Column:
        n = F.regexp_count(done["masked"], x["pattern"])
        return F.struct(F.regexp_replace(done["masked"], x["pattern"], F.concat(F.lit("<ANSWER_CHOICE_"), x["k"].cast("string"), F.lit(">"))).alias("masked"), F.concat(done["matches"], F.array_repeat(x["k"], n)).alias("matches"))

    return F.aggregate(ordered, F.struct(form.alias("masked"), F.array().cast("array<int>").alias("matches")), step)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def cot_target(text: Column) -> Column:
    """struct<reasoning, final>: the last sentence, and those before it; a single one is both."""
    s = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"(?<=[.!?]) +")
    return F.struct(F.when(F.size(s) == 1, s[0]).otherwise(F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), " ")).alias("reasoning"), F.element_at(s, -1).alias("final"))


def render_references(words: Column, names: Column) -> Column:
    """Words joined by spaces, those that are numbers in range as <name>_<number>."""
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[0-9]{1,9}$") & (w.try_cast("int") < F.size(names)), F.concat(F.get(names, w.try_cast("int")), F.lit("_"), w)).otherwise(w)), " ")


def references(text: Column, names: Column) -> Column:
    """Mentions <name>_<number> in text whose number has that name."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\w+_[0-9]{1,9}"), F.lit(0)), lambda m: F.coalesce(F.get(names, F.substring_index(m, "_", -1).cast("int")) == F.substring_index(m, "_", 1), F.lit(False)))


def tex(c: Column) -> Column:
    """Escaped for LaTeX, each character once."""
    return F.regexp_replace(F.regexp_replace(c, r"([&%$#_{}])", r"\\$1"), "~", r"\\textasciitilde{}")


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def clean_generated(c: Column, prefixes: tuple[str, ...]) -> Column:
    """Non-empty lines joined by spaces, without those at the start that begin with a prefix; the text itself if no line is left."""
    lines = F.filter(F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit(" ")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def boilerplate(x: Column) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | x.startswith(p)
        return hit

    first = F.coalesce(F.array_position(F.transform(lines, boilerplate), F.lit(False)), F.lit(0))
    return F.when(first == 0, c).otherwise(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(1))), " "))


def fixed(c: Column, digits: int, signed: bool = False) -> Column:
    """A number to so many places, with a sign if asked for; what rounds to zero has none."""
    shown = F.format_string(f"%.{digits}f", F.abs(c))
    zero = F.lit("0." + "0" * digits if digits else "0")
    sign = F.when(shown == zero, "").when(c < 0, "-").otherwise("+" if signed else "")
    return F.concat(sign, shown)


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def interval(mean: Column, low: Column, high: Column, n: Column, digits: int = 4) -> Column:
    """mean [low, high]; n=count."""
    return F.concat(fixed(mean, digits), F.lit(" ["), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit("]; n="), n.cast("string"))


def count_share(n: Column, of: Column, digits: int = 1) -> Column:
    """count (per cent), or count alone of nothing."""
    return F.when(of == 0, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit(" ("), fixed(100 * n / of, digits), F.lit("%)")))
