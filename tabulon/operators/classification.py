"""Confusion matrices, per-class reports, calibration and softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .accuracy import share

CLASSES = 4


def confusion(p: DataFrame, gold: str = "gold", pred: str = "pred", k: int = CLASSES) -> DataFrame:
    """A row for each gold class, counts by prediction; classes without rows have zeros."""
    cells = [F.count_if(F.col(pred) == j).alias(f"pred_{j}") for j in range(k)]
    have = p.where(F.col(gold).isNotNull()).groupBy(F.col(gold).cast("int").alias("gold")).agg(*cells)
    every = p.sparkSession.range(k).select(F.col("id").cast("int").alias("gold"))
    return every.join(have, "gold", "left").select("gold", *[F.coalesce(f"pred_{j}", F.lit(0)).alias(f"pred_{j}") for j in range(k)])


def report(p: DataFrame, k: int = CLASSES) -> DataFrame:
    """Support, predicted, precision, recall and F1 of each class, with 1e-12 in denominators, from one aggregate."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("cls"), (F.col("gold") == j).cast("int").alias("g"), (F.col("pred") == j).cast("int").alias("p")) for j in range(k)]))
    a = p.select(each.alias("e")).groupBy(F.col("e.cls").alias("cls")).agg(F.sum("e.g").alias("support"), F.sum("e.p").alias("predicted"), F.sum(F.col("e.g") * F.col("e.p")).alias("hits"))
    precision, recall = F.col("hits") / (F.col("predicted") + 1e-12), F.col("hits") / (F.col("support") + 1e-12)
    return a.select("cls", "support", "predicted", "hits", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(2 * precision * recall / (precision + recall + 1e-12), 9).alias("f1"))


def overall(p: DataFrame, k: int = CLASSES) -> DataFrame:
    """One row: macro means over the classes, micro precision, recall and F1, and accuracy, with 1e-12 in denominators."""
    cells = confusion(p, k=k)
    by = [f"pred_{j}" for j in range(k)]
    row = sum((F.col(x) for x in by), F.lit(0))
    own = lambda j, c: F.when(F.col("gold") == j, c).otherwise(0)
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(j).alias("cls"), F.col(c).alias("n"), own(j, F.col(c)).alias("own"), own(j, row).alias("sup")) for j, c in enumerate(by)])).alias("e"))
    c = each.groupBy("e.cls").agg(F.sum("e.n").alias("predicted"), F.sum("e.own").alias("hits"), F.sum("e.sup").alias("support"))
    precision, recall = F.col("hits") / (F.col("predicted") + 1e-12), F.col("hits") / (F.col("support") + 1e-12)
    f1 = 2 * precision * recall / (precision + recall + 1e-12)
    a = c.agg(F.avg(precision).alias("mp"), F.avg(recall).alias("mr"), F.avg(f1).alias("mf"), F.sum("hits").alias("h"), F.sum("predicted").alias("p"), F.sum("support").alias("s"))
    up, ur = F.col("h") / (F.col("p") + 1e-12), F.col("h") / (F.col("s") + 1e-12)
    r = lambda c, name: F.round(c, 9).alias(name)
    return a.select(r(F.col("mp"), "macro_precision"), r(F.col("mr"), "macro_recall"), r(F.col("mf"), "macro_f1"), r(up, "micro_precision"), r(ur, "micro_recall"), r(2 * up * ur / (up + ur + 1e-12), "micro_f1"), share(F.col("h"), F.col("s")).alias("accuracy"))


def bin_of(confidence: Column, bins: int) -> Column:
    """Bins open to the left and closed to the right; 0 itself is in none (-1)."""
    return F.when(confidence > 0, F.least(F.ceil(confidence * bins), F.lit(bins)) - 1).otherwise(-1).cast("int")


def calibration(p: DataFrame, by: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """Each bin's rows, accuracy and mean confidence, and its share of the expected calibration error. Bins without rows are absent: see calibration_table."""
    b = p.withColumn("bin", bin_of(F.col("confidence"), bins)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg("confidence").alias("conf"))
    total = b.groupBy(*by).agg(F.sum("n").alias("total"))
    held = b.join(total, list(by)) if by else b.crossJoin(F.broadcast(total))  # one row of totals
    return held.where("bin >= 0").select(*by, "bin", "n", F.round("acc", 9).alias("accuracy"), F.round("conf", 9).alias("mean_confidence"), F.round(F.abs(F.col("acc") - F.col("conf")) * F.col("n") / F.col("total"), 9).alias("error_share"))


def calibration_table(p: DataFrame, bins: int = 10) -> DataFrame:
    """calibration() with every bin: those without rows have n = 0, no accuracy and no share of the error."""
    every = p.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(calibration(p, (), bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence", F.coalesce("error_share", F.lit(0.0)).alias("error_share"))


def expected_error_of_classes(p: DataFrame, k: int, cls: str = "pred", bins: int = 10) -> DataFrame:
    """The expected calibration error of each class from 0 to k - 1; null for a class without rows."""
    every = p.sparkSession.range(k).select(F.col("id").cast("int").alias(cls))
    return every.join(expected_error(p, (cls,), bins), cls, "left").select(cls, "ece", F.coalesce("n", F.lit(0)).alias("n"))


def expected_error(p: DataFrame, by: tuple[str, ...], bins: int = 10) -> DataFrame:
    return calibration(p, by, bins).groupBy(*by).agg(F.round(F.sum("error_share"), 6).alias("ece"), F.sum("n").alias("n"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def with_prediction(df: DataFrame, logits: str) -> DataFrame:
    """Adds probabilities, pred (the first of largest ones) and confidence."""
    out = df.withColumn("probabilities", softmax(F.col(logits)))
    return out.withColumn("confidence", F.array_max("probabilities")).withColumn("pred", (F.array_position(logits, F.array_max(logits)) - 1).cast("int"))


def confidence_means(p: DataFrame, by: str) -> DataFrame:
    """Mean confidence of all, of correct and of wrong rows; 0 where there are none."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("confidence"))), F.lit(0.0)), 9)
    return p.groupBy(by).agg(mean(F.lit(True)).alias("mean_all"), mean(F.col("correct") == 1).alias("mean_correct"), mean(F.col("correct") == 0).alias("mean_wrong"), share(F.sum("correct"), F.count("*")).alias("accuracy"))
