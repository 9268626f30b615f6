"""Consistency of a judge's choices with targets, and where texts come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_debris, parse_tolerant, squeeze
from .accuracy import share


def cells(p: DataFrame) -> DataFrame:
    """p: arm, setting, eligible, correct, base_correct, failed. Conditional and pipeline rates: what fails or isn't eligible is wrong in the pipeline, only what isn't eligible is absent from the conditional rate."""
    ok = F.col("eligible") & (F.col("correct") == 1) & ~F.col("failed")
    n, e, k = F.count("*"), F.count_if("eligible"), F.count_if(ok)
    out = p.groupBy("arm", "setting").agg(
        n.alias("n"), e.alias("eligible"), k.alias("recovered"), share(e, n).alias("coverage"), share(k, e).alias("conditional"), share(k, n).alias("pipeline"),
        share(F.count_if(F.expr("base_correct = 1")), n).alias("baseline_all"), share(F.count_if(F.expr("eligible and base_correct = 1")), e).alias("baseline_eligible"), F.count_if("failed").alias("failures"),
    )
    return out.withColumn("residual", F.round(F.abs(F.col("pipeline") - F.col("coverage") * F.col("conditional")), 6))


def lineage(df: DataFrame, current: str, generated: str, final: str, reasoning: str, same_file: str) -> DataFrame:
    """Adds lineage and lineage_ok: how a final span came from the fields of the record it was made of."""
    c, g, f, r = (squeeze(F.coalesce(F.col(x), F.lit(""))) for x in (current, generated, final, reasoning))
    debris = has_debris(g) | has_debris(f) | has_debris(r)
    # the longest field, the first of equal ones
    longest = F.when((F.length(g) >= F.length(f)) & (F.length(g) >= F.length(r)), "generated").when(F.length(f) >= F.length(r), "final").otherwise("reasoning")
    chosen = F.when(longest == "generated", g).when(longest == "final", f).otherwise(r)
    status = (
        F.when(c == "", "empty_final")
        .when(F.col(same_file) & (c == f) & (f == g), "verified_written")
        .when(F.col(same_file), "ambiguous_fields_differ")
        .when(~debris & ((c == g) | (c == f)), "verified_unchanged")
        .when(~debris, "ambiguous_without_debris")
        .when(c != squeeze(parse_tolerant(chosen)["final"]), "ambiguous_parse_differs")
        .when(longest == "reasoning", "ambiguous_from_reasoning")
        .otherwise(F.concat(F.lit("verified_parsed_from_"), longest))
    )
    return df.withColumn("lineage", status).withColumn("lineage_ok", F.col("lineage").startswith("verified"))


def parse_coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """df: strict and tolerant status columns. Counts of what each parser finds."""
    flag = lambda c, v: F.count_if(F.col(c) == v)
    names = ("both", "reasoning_only", "final_only", "none")
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[flag("strict", v).alias(f"strict_{v}") for v in names], *[flag("tolerant", v).alias(f"tolerant_{v}") for v in names], F.to_json(F.array_sort(F.collect_set("strict"))).alias("statuses"))
