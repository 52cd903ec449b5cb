"""Ordinal classification metrics from ``(y, p)`` rows: one 3 x 3 count, then nine-row arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in CLASSES for b in CLASSES], "y int, p int")


def confusion(rows: DataFrame) -> DataFrame:
    """(y, p, n, share): zero cells kept; share of the row, 0 for an empty one."""
    n = rows.where(F.col("y").isin(*CLASSES) & F.col("p").isin(*CLASSES)).groupBy("y", "p").agg(F.count("*").alias("n"))
    full = _grid(rows.sparkSession).join(n.select(F.col("y").cast("int"), F.col("p").cast("int"), "n"), ["y", "p"], "left").fillna(0, ["n"])
    total = full.groupBy("y").agg(F.sum("n").alias("t"))
    return full.join(total, "y").select("y", "p", "n", F.coalesce(F.try_divide("n", "t"), F.lit(0.0)).alias("share"))


def per_class(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support); 0 where undefined."""
    cells = confusion(rows)
    sides = [
        cells.select(F.col("y").alias("class"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")),
        cells.select(F.col("p").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said")),
    ]
    c = reduce(DataFrame.unionByName, sides).groupBy("class").agg(*(F.sum(x).alias(x) for x in ("hit", "true", "said")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("class", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("true")).alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("true")).alias("f1"), F.col("true").alias("support"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: macro_f1, ordinal_mae, balanced_accuracy, accuracy, kappa (quadratic weights)."""
    by_class = per_class(rows).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    cells = confusion(rows)
    n, t, p = F.col("n"), cells.groupBy("y").agg(F.sum("n").alias("ty")), cells.groupBy("p").agg(F.sum("n").alias("tp"))
    gap = F.abs(F.col("y") - F.col("p"))
    flat = cells.join(t, "y").join(p, "p")  # nine rows
    sums = flat.agg(F.sum("n").alias("all"), (F.sum(n * gap) / F.sum("n")).alias("ordinal_mae"), (F.sum(F.when(gap == 0, n).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum(n * gap * gap).alias("seen"), F.sum(F.col("ty") * F.col("tp") * gap * gap).alias("due"), F.sum(F.when(F.col("ty") > 0, 1).otherwise(0)).alias("present"))
    kappa = F.when(F.col("present") <= len(CLASSES), 1.0).otherwise(F.coalesce(1 - F.try_divide(F.col("seen") * F.col("all"), F.col("due")), F.lit(1.0)))
    both = by_class.join(sums, F.lit(True))  # one row each
    return both.select(*(F.round(c, 9).alias(c) for c in ("macro_f1", "ordinal_mae", "balanced_accuracy", "accuracy")), F.round(kappa, 9).alias("kappa"))


def brier(rows: DataFrame) -> DataFrame:
    """One row: brier, the mean over ``(y, p0, p1, p2)`` of the squared distance to the class's unit vector."""
    parts = (F.pow(F.col(f"p{c}") - (F.col("y") == c).cast("double"), 2) for c in CLASSES)
    return rows.agg(F.round(F.avg(sum(parts, F.lit(0.0))), 9).alias("brier"))


def best_run(runs: DataFrame) -> DataFrame:
    """The run of highest macro_f1, then lowest ordinal_mae, highest balanced_accuracy, first run_id."""
    return runs.orderBy(F.col("macro_f1").desc(), "ordinal_mae", F.col("balanced_accuracy").desc(), "run_id").limit(1)


def majority(rows: DataFrame) -> DataFrame:
    """The most frequent class ``y``, the lowest among equals."""
    return rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "y").limit(1)


def ladder_deltas(runs: DataFrame) -> DataFrame:
    """``(step, run_id, macro_f1)`` with the gain over the first step and over the one before; a few rows."""
    order = Window.orderBy("step")
    first = F.first("macro_f1").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return runs.select("step", "run_id", "macro_f1", F.round(F.col("macro_f1") - first, 9).alias("over_first"), F.round(F.col("macro_f1") - F.lag("macro_f1").over(order), 9).alias("over_previous"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over ``(y, p, conf)``; the last bin is closed, empty bins are kept."""
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    got = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))
    full = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left")
    return full.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))
