"""Accuracy batteries over predictions: arm, condition, record_id, frame_id, correct (0/1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("arm", "condition")


def share(part: Column, whole: Column) -> Column:
    """part / whole to 9 places, null where whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 9)


def battery(p: DataFrame) -> DataFrame:
    """Each cell's records, frames, correct and wrong ones, and accuracy."""
    n, right = F.count("*"), F.sum("correct")
    return p.groupBy(*CELL).agg(n.alias("n"), F.countDistinct("frame_id").alias("frames"), right.alias("n_correct"), (n - right).alias("n_wrong"), share(right, n).alias("accuracy"))


def counts(p: DataFrame) -> DataFrame:
    return p.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))


def source_gap(p: DataFrame, base: str = "source") -> DataFrame:
    """Each condition's accuracy less that of the base condition in its arm. Aggregated before joining, so only cells meet."""
    c = counts(p)
    s = c.where(F.col("condition") == base).select("arm", share(F.col("k"), F.col("n")).alias("base_accuracy"))
    both = c.where(F.col("condition") != base).join(s, "arm")
    return both.select(*CELL, share(F.col("k"), F.col("n")).alias("accuracy"), "base_accuracy", F.round(share(F.col("k"), F.col("n")) - F.col("base_accuracy"), 9).alias("gap"))


def paired(p: DataFrame, base: str = "source") -> DataFrame:
    """Each record's correctness under a condition (c) beside that under base (s).

    Both stand in one row after a single shuffle by arm and record: the record's
    outcomes are gathered (as many as there are conditions) and exploded."""
    own = p.groupBy("arm", "record_id").agg(F.max(F.when(F.col("condition") == base, F.col("correct"))).alias("s"), F.first("frame_id").alias("frame_id"), F.collect_list(F.when(F.col("condition") != base, F.struct("condition", "correct"))).alias("others"))
    return own.where("s is not null").select("arm", "record_id", "frame_id", "s", F.explode("others").alias("o")).select("arm", "record_id", "frame_id", "s", F.col("o.condition").alias("condition"), F.col("o.correct").alias("c"))


def transitions(p: DataFrame, base: str = "source") -> DataFrame:
    """Correct and wrong before and after: the four counts, their rates over their own denominators, churn, net and if the identity holds."""
    when = lambda s, c: F.count_if((F.col("s") == s) & (F.col("c") == c))
    t = paired(p, base).groupBy(*CELL).agg(F.count("*").alias("n"), when(1, 1).alias("cc"), when(1, 0).alias("cw"), when(0, 1).alias("wc"), when(0, 0).alias("ww"), F.sum("s").alias("ks"), F.sum("c").alias("kc"))
    c = F.col
    return t.select(
        *CELL, "n", "cc", "cw", "wc", "ww", share(c("cw"), c("cc") + c("cw")).alias("cw_rate"), share(c("wc"), c("wc") + c("ww")).alias("wc_rate"),
        (c("cw") + c("wc")).alias("churn"), share(c("cw") + c("wc"), c("n")).alias("churn_rate"), (c("wc") - c("cw")).alias("net"),
        ((c("ks") - c("kc") == c("cw") - c("wc")) & (c("cc") + c("cw") + c("wc") + c("ww") == c("n"))).alias("identity_holds"),
    )


def gap_contrast(p: DataFrame, pairs: list[tuple[str, str]], condition: str = "grey", base: str = "source") -> DataFrame:
    """Difference of two arms' gaps between base and condition, for each pair (left, right)."""
    g = p.where(F.col("condition").isin(base, condition)).groupBy("arm").agg(
        share(F.sum(F.when(F.col("condition") == base, F.col("correct"))), F.count_if(F.col("condition") == base)).alias("a"),
        share(F.sum(F.when(F.col("condition") == condition, F.col("correct"))), F.count_if(F.col("condition") == condition)).alias("b"),
    )
    gaps = g.select("arm", (F.col("a") - F.col("b")).alias("gap"))
    return _contrast(gaps, "gap", pairs)


def rate_contrast(p: DataFrame, pairs: list[tuple[str, str]], condition: str = "grey", base: str = "source") -> DataFrame:
    """Difference of two arms' rates of correct records that the condition turns wrong, each over its own denominator."""
    t = transitions(p.where(F.col("condition").isin(base, condition)), base)
    return _contrast(t.select("arm", F.col("cw_rate").alias("rate")), "rate", pairs)


def _contrast(values: DataFrame, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    spec = F.array(*[F.struct(F.lit(a).alias("left_arm"), F.lit(b).alias("right_arm")) for a, b in pairs])
    side = values.withColumn("p", F.explode(spec)).where((F.col("arm") == F.col("p.left_arm")) | (F.col("arm") == F.col("p.right_arm")))
    left = F.max(F.when(F.col("arm") == F.col("p.left_arm"), F.col(value)))
    right = F.max(F.when(F.col("arm") == F.col("p.right_arm"), F.col(value)))
    return side.groupBy("p").agg(left.alias("l"), right.alias("r")).select("p.left_arm", "p.right_arm", F.round("l", 9).alias("left_value"), F.round("r", 9).alias("right_value"), F.round(F.col("l") - F.col("r"), 9).alias("difference"))


def wide(p: DataFrame, conditions: list[str]) -> DataFrame:
    """A row for each arm and record with pred_<condition> and correct_<condition>."""
    cols = [F.max(F.when(F.col("condition") == c, F.col(v))).alias(f"{v}_{c}") for c in conditions for v in ("pred", "correct")]
    return p.groupBy("arm", "record_id").agg(F.first("gold").alias("gold"), *cols)


def long_again(w: DataFrame, conditions: list[str]) -> DataFrame:
    """The inverse of wide()'s correct columns."""
    return w.unpivot(["arm", "record_id"], [f"correct_{c}" for c in conditions], "condition", "correct").withColumn("condition", F.substring_index("condition", "_", -1))


def supersession(p: DataFrame, old: str, new: str) -> DataFrame:
    """Accuracy of a condition and of the one that supersedes it."""
    rate = lambda c: share(F.sum(F.when(F.col("condition") == c, F.col("correct"))), F.count_if(F.col("condition") == c))
    return p.where(F.col("condition").isin(old, new)).groupBy("arm").agg(rate(old).alias("old_accuracy"), rate(new).alias("new_accuracy")).withColumn("change", F.round(F.col("new_accuracy") - F.col("old_accuracy"), 9))


def overlap(p: DataFrame, left: str, right: str) -> DataFrame:
    """How two conditions' outcomes differ, record by record."""
    w = p.where(F.col("condition").isin(left, right)).groupBy("arm", "record_id").agg(F.max(F.when(F.col("condition") == left, F.col("correct"))).alias("a"), F.max(F.when(F.col("condition") == right, F.col("correct"))).alias("b"))
    w = w.where("a is not null and b is not null")
    diff = F.count_if(F.col("a") != F.col("b"))
    return w.groupBy("arm").agg(F.count("*").alias("n"), diff.alias("n_different"), share(diff, F.count("*")).alias("share_different"), F.count_if(F.expr("a = 0 and b = 0")).alias("wrong_in_both"), F.count_if(F.expr("a = 0 and b = 1")).alias("wrong_left_only"), F.count_if(F.expr("a = 1 and b = 0")).alias("wrong_right_only"), F.bool_and(F.col("a") == F.col("b")).alias("identical"))


def strata(p: DataFrame, stratum: str) -> DataFrame:
    """Counts by arm and stratum with arm totals (stratum null), in one pass of grouping sets."""
    return p.rollup("arm", stratum).agg(F.count("*").alias("n"), F.sum("correct").alias("n_correct"), (F.count("*") - F.sum("correct")).alias("n_wrong"), F.grouping(stratum).alias("is_total")).where("arm is not null")
