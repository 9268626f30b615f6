"""Numbers as tables print them: read back with their places, and checked against what they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a whole cell may be, first match first: kind and pattern.
KINDS = (
    ("integer", r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)$"),
    ("decimal", r"^[+-]?[0-9]+\.[0-9]+$"),
    ("percent", r"^[+-]?[0-9]+(?:\.[0-9]+)?\\?%$"),
)
_INTERVAL = r"^([+-]?[0-9]+\.[0-9]+) \[([+-]?[0-9]+\.[0-9]+), ([+-]?[0-9]+\.[0-9]+)\]; n=([0-9,]+)$"
_NUMBER = "array<struct<cell:int,part:int,kind:string,text:string,value:decimal(28,10),digits:int>>"


def cells(line: Column, sep: str = "&") -> Column:
    """A rendered row's cells, trimmed; its end mark is none of them, nor are the bars around a row."""
    body = F.regexp_replace(F.coalesce(line, F.lit("")), r"\s*\\\\\s*$", "")
    if sep == "|":
        body = F.regexp_replace(body, r"^\s*\||\|\s*$", "")
    return F.transform(F.split(body, f"[{sep}]"), lambda c: F.trim(F.regexp_replace(c, r"^\\text(?:bf|it)\{(.*)\}$", "$1")))


def numbers(line: Column, sep: str = "&") -> Column:
    """array<struct<cell, part, kind, text, value, digits>>: the numbers of a rendered row in order.

    cell counts from 0; an interval (mean [low, high]; n=count) is four parts of
    kind mean, low, high and count. digits is how many are printed after the
    point. Cells that are no number are left out."""

    def one(text: Column, cell: Column, part: int, kind: Column) -> Column:
        plain = F.regexp_replace(text, r"[,%\\+]", "")
        digits = F.length(F.regexp_extract(plain, r"\.([0-9]+)$", 1))
        return F.struct(cell.cast("int").alias("cell"), F.lit(part).alias("part"), kind.alias("kind"), text.alias("text"), plain.try_cast("decimal(28,10)").alias("value"), digits.alias("digits"))

    def of(c: Column, k: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(KINDS):
            kind = F.when(c.rlike(pattern), name).otherwise(kind)
        parts = F.array(*[one(F.regexp_extract(c, _INTERVAL, n + 1), k, n, F.lit(name)) for n, name in enumerate(("mean", "low", "high", "count"))])
        return F.when(c.rlike(_INTERVAL), parts.cast(_NUMBER)).when(kind.isNotNull(), F.array(one(c, k, 0, kind)).cast(_NUMBER)).otherwise(F.array().cast(_NUMBER))

    return F.flatten(F.transform(cells(line, sep), of))


def tokens(lines: DataFrame, keys: list[str], line: str = "line", sep: str = "&") -> DataFrame:
    """keys and the numbers of each line, a row each. Lines without a separator hold no cells."""
    return lines.where(F.col(line).contains(sep)).select(*keys, F.inline(numbers(F.col(line), sep)))


def ratio_checks(lines: DataFrame, keys: list[str], spec: list[tuple[int, int, int]], line: str = "line", sep: str = "&") -> DataFrame:
    """keys, cell, printed, numerator, denominator, holds: for each (rate cell, numerator cell, denominator cell) of each line that has all three as numbers.

    A rate holds if it is a nearest one of its printed digits to the ratio, in
    whole numbers, so no rounding of doubles comes between; a tie has two. A
    ratio over nothing holds for no rate."""
    n = lines.where(F.col(line).contains(sep)).select(*keys, numbers(F.col(line), sep).alias("n"))
    at = lambda cell, kinds: F.try_element_at(F.filter("n", lambda x: (x["cell"] == cell) & x["kind"].isin(*kinds)), F.lit(1))
    each = F.array(*[F.struct(F.lit(r).alias("cell"), at(r, ["decimal"]).alias("r"), at(a, ["integer"]).alias("a"), at(b, ["integer"]).alias("b")) for r, a, b in spec])
    found = n.select(*keys, F.explode(each).alias("x")).where("x.r is not null and x.a is not null and x.b is not null")
    scale = F.pow(F.lit(10), F.col("x.r.digits")).cast("decimal(10,0)")
    whole = (F.col("x.r.value") * scale).cast("decimal(20,0)")
    a, b = F.col("x.a.value").cast("decimal(18,0)"), F.col("x.b.value").cast("decimal(18,0)")
    return found.select(*keys, "x.cell", F.col("x.r.text").alias("printed"), a.cast("long").alias("numerator"), b.cast("long").alias("denominator"), ((b != 0) & (2 * F.abs(whole * b - a * scale) <= F.abs(b))).alias("holds"))


def unaccounted(printed: DataFrame, counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Printed integers (of tokens()) that aren't among the counts of the same keys: each once, with how often it is printed. What both sides repeat is taken once before they meet."""
    own = printed.where("kind in ('integer', 'count')").select(*keys, F.col("value").cast("long").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("times"))
    known = counts.select(*keys, F.col(value).cast("long").alias("_v")).distinct()
    return own.join(known, [*keys, "_v"], "left_anti").withColumnRenamed("_v", "integer")
