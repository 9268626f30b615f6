"""Audits of tables beside each other: fields, ledgers, counts, tokens, columns, order of appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consecutive index values that are numbered together.
BLOCK = 4096


def both_ways(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rows of a, and how many rows each has that the other hasn't, repeats counted. One shuffle of both."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_d")).unionByName(b.select(*columns, F.lit(-1).alias("_d")))
    each = both.groupBy(*columns).agg(F.sum("_d").alias("d"), F.count_if(F.col("_d") == 1).alias("k"))
    over = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("int")
    return each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), over(F.col("d")).alias(left), over(-F.col("d")).alias(right))


def field_mismatches(tables: list[tuple[str, DataFrame]], key: str, fields: dict[str, list[str]]) -> DataFrame:
    """Rows of the first table joined to the others by key, with found: names 'table.field' where a table's field differs from the first one's (null is a value), or 'table' where it lacks the key."""
    _, out = tables[0]
    wrong: list[Column] = []
    for name, df in tables[1:]:
        own = df.select(F.col(key), F.lit(True).alias(f"_{name}"), *[F.col(f).alias(f"_{name}_{f}") for f in fields[name]])
        out = out.join(own, key, "left")
        there = F.col(f"_{name}")
        wrong.append(F.when(there.isNull(), F.lit(name)))
        wrong += [F.when(there & ~F.col(f).eqNullSafe(F.col(f"_{name}_{f}")), F.lit(f"{name}.{f}")) for f in fields[name]]
    return out.select(key, F.array_compact(F.array(*wrong)).alias("found"))


def ledger_status(files: DataFrame, ledger: DataFrame, key: str, digest: str) -> DataFrame:
    """files without digest, with status: 'match', 'differs', or 'unlisted' where the ledger lacks the key (null is a key).

    One row a file, whatever its key repeats: a file matches if any of the digests listed under its key is its own."""
    listed = ledger.select(F.col(key).alias("_key"), F.col(digest).alias("_listed")).distinct().withColumn("_own", F.lit(True))
    keys = listed.select(F.col("_key").alias("_there")).distinct().withColumn("_known", F.lit(True))
    met = files.join(listed, F.col(key).eqNullSafe(F.col("_key")) & F.col(digest).eqNullSafe(F.col("_listed")), "left").join(keys, F.col(key).eqNullSafe(F.col("_there")), "left")
    status = F.when(F.col("_own"), "match").when(F.col("_known"), "differs").otherwise("unlisted")
    return met.select(*[c for c in files.columns if c != digest], status.alias("status"))


def expected_counts(counts: DataFrame, expected: dict[str, Column]) -> DataFrame:
    """counts: one row. check, expected, actual and if they agree, for each column named in expected."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), e.cast("long").alias("expected"), F.col(n).cast("long").alias("actual")) for n, e in expected.items()]))
    return counts.select(each.alias("c")).select("c.*", (F.col("c.expected") == F.col("c.actual")).alias("holds"))


def failed(checks: DataFrame, holds: str = "holds") -> None:
    """Raises after all checks have run if any doesn't hold, with what each of them found."""
    wrong = checks.where(~F.coalesce(holds, F.lit(False))).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(str(r.asDict()) for r in wrong))


def column_policy(df: DataFrame, allowed: list[str]) -> DataFrame:
    """column, if it is allowed, and how many values it has."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in allowed).alias("allowed"), F.col(c).alias("n")) for c in df.columns]))
    return counted.select(each.alias("c")).select("c.*")


def token_policy(df: DataFrame, text: str, required: list[str], forbidden: list[str]) -> DataFrame:
    """token, kind, and how many texts have it: a report passes if it has all required ones and none that is forbidden."""
    tokens = [(t, "required") for t in required] + [(t, "forbidden") for t in forbidden]
    sums = df.agg(*[F.count_if(F.contains(F.col(text), F.lit(t))).alias(f"t{k}") for k, (t, _) in enumerate(tokens)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(kind).alias("kind"), F.col(f"t{k}").alias("n")) for k, (t, kind) in enumerate(tokens)])).alias("t")).select("t.*")


def where_if_present(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows with this value, if the table has such a column; else all."""
    return df.where(F.col(column) == value) if column in df.columns else df


def first_eligible(df: DataFrame, by: list[str], eligible: Column, order: str, what: str) -> DataFrame:
    """For each group the eligible row that comes first, as a partial aggregate."""
    return df.where(eligible).groupBy(*by).agg(F.min(order).alias(order), F.min_by(what, order).alias(what))


def appearance(df: DataFrame, cluster: str, order: str) -> DataFrame:
    """Clusters numbered from 0 by where they first stand: blocks of BLOCK order values are numbered alone, then moved by the sizes of those before them, so rows don't meet in one task."""
    from pyspark.sql import Window

    first = df.groupBy(cluster).agg(F.min(order).alias("first")).withColumn("_b", F.floor(F.col("first") / BLOCK))
    sizes = first.groupBy("_b").agg(F.count("*").alias("n"))
    before = sizes.select("_b", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("first", cluster)) - 1
    return first.withColumn("k", own).join(before, "_b").select(cluster, "first", (F.col("k") + F.col("before")).alias("place"))
