"""Operator 5, native: quality rules as one projection of a threshold table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space that parts words, and code points that count as symbols (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A row fails if value < low or value > high; value is SQL over the measures."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios of an empty text are 0.
RULES = (
    Rule("words", "n_words", 10, None),
    Rule("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols_to_words", "n_symbols / n_words", None, 0.25),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("stop_words", "(n_stop + 1) / n_words", 0.03, None),  # one is granted, as short texts may have none
    Rule("bullet_lines", "n_bullet / n_lines", None, 0.9),
)

#: Frequent words of the languages handled (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an a have not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus bei nach wie "
    "le la les de et des en un une du que est pour qui dans par sur pas plus au ce il ne se sont avec "
    "el los las y que del se por con para una su al lo como más o pero sus no"
).split()


def _occurrences(text: Column, characters: str) -> Column:
    """How often these ASCII characters stand in text: bytes that go when each is cut out."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document; a null text has no words, and repeated rows stay repeated.

    Nothing is shuffled: a document's words and windows stay arrays of its row.
    Only where two window hashes are equal are they sorted with their positions,
    and what the windows with an equal neighbour cover is added up."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACES))
    worded = text.withColumn("_words", F.when(F.octet_length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    window = ", ".join(f"_words[i + {k}]" for k in range(WINDOW))
    hashed = worded.select(
        "doc_id", "_text", "_words", F.size("_words").alias("n_words"),
        F.expr(f"if(size(_words) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64({window})))").alias("_h"),
        F.expr(r"filter(split(_text, '\n'), l -> octet_length(btrim(l, '\u0009\u000b\u000c\r ')) > 0)").alias("_lines"),
    )
    ordered = hashed.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, p) -> named_struct('h', h, 'p', p))), null)"))
    twice = """if(_s is null, null, sort_array(filter(zip_with(zip_with(_s, concat(array(cast(null as bigint)), slice(_s.h, 1, size(_s) - 1)),
        (x, before) -> named_struct('h', x.h, 'p', x.p, 'twice', coalesce(x.h = before, false))), concat(slice(_s.h, 2, size(_s) - 1), array(cast(null as bigint))),
        (x, after) -> if(x.twice or coalesce(x.h = after, false), x.p, null)), p -> p is not null)))"""
    marked = ordered.withColumn("_twice", F.expr(twice))
    covered = f"""cast(if(_twice is null, 0, {WINDOW} + aggregate(zip_with(slice(_twice, 2, size(_twice)), slice(_twice, 1, size(_twice) - 1),
        (b, a) -> least(b - a, {WINDOW})), 0, (acc, x) -> acc + x)) as bigint)"""
    return marked.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        (F.char_length("_text") - _occurrences(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        _occurrences(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
        F.size(F.filter("_lines", lambda line: F.btrim(line, F.lit(SPACES)).substr(1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with base_failed, failed (names of the rules that the text breaks) and kept.

    Empty and null texts have no words, break the rule for words and aren't kept."""
    m = measures(docs, id_col, text_col)
    broken = []
    for r in rules:
        value = F.coalesce(F.try_divide(*map(F.expr, r.value.split(" / "))) if " / " in r.value else F.expr(r.value), F.lit(0.0))
        off = F.lit(False)
        if r.low is not None:
            off = off | (value < r.low)
        if r.high is not None:
            off = off | (value > r.high)
        broken.append(F.when(off, F.lit(r.name)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumns({"base_failed": base, "failed": F.array_compact(F.array(*broken))}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules() of all documents; repeated rows come back as often, an empty table gives no rows."""
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
