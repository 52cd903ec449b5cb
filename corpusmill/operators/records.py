"""Records: label normalisation, the ordered reject cascade, identity, exact duplicates, gates, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import dedup_norm, fold, strip
from corpusmill.lexicons import CLASSES, LABELS
from corpusmill.session import free_name, named

MAX_CHARS = 20000
MAX_REJECT_RATIO = 0.02


def normal_label(raw: str, labels: dict[str, str] = LABELS) -> Column:
    """The class of a raw label whatever its case and white space around it; null if it has none."""
    by_key = {k.strip().casefold(): v for k, v in labels.items()}
    key = fold(strip(F.col(raw).cast("string")))
    return F.coalesce(*(F.when(key.isin([k for k, v in by_key.items() if v == c]), c) for c in CLASSES))


def label_number(label: str | Column) -> Column:
    """0, 1, 2 for the classes in order; a number stays; null for others."""
    c = F.col(label) if isinstance(label, str) else label
    at = F.array_position(F.array(*map(F.lit, CLASSES)), c.cast("string"))
    return F.when(at > 0, at - 1).otherwise(c.cast("string").try_cast("int")).cast("int")


def with_reason(rows: DataFrame, max_chars: int = MAX_CHARS, labels: dict[str, str] = LABELS) -> DataFrame:
    """Adds ``label`` and ``reason``, the first rule that fails; null for an accepted record.

    A reason the rows have already (malformed input) comes first; then missing_question, oversized, unknown_label.
    """
    labelled = rows.withColumn("label", normal_label("raw_label", labels))
    blank = F.col("question").isNull() | (strip(F.col("question")) == "")
    reason = F.when(blank, "missing_question").when(F.length("question") > max_chars, "oversized").when(F.col("label").isNull(), "unknown_label")
    return labelled.withColumn("reason", F.coalesce("reason", reason) if "reason" in rows.columns else reason)


def check_reject_ratio(rows: DataFrame, most: float = MAX_REJECT_RATIO) -> None:
    """Raises if more than that share of ``with_reason`` rows is rejected; equality passes."""
    n, bad = rows.agg(F.count("*"), F.count("reason")).first()
    if n and bad / n > most:
        raise ValueError(f"rejection_rate_exceeded:{bad}/{n}:{bad / n:.6f}")


def with_identity(rows: DataFrame, question: str = "question", supplied: str | None = None) -> DataFrame:
    """Adds ``raw_hash``, and ``question_id``: the supplied one if there is, else 16 hex digits of the hash."""
    out = rows.withColumn("raw_hash", F.sha2(dedup_norm(question), 256))
    own = F.substring("raw_hash", 1, 16)
    given = F.when(F.col(supplied).cast("string") != "", F.col(supplied).cast("string")) if supplied else F.lit(None)
    return out.withColumn("question_id", F.coalesce(given, own))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(raw_hash, kept_id, copies, conflict) per distinct text; counts before the shuffle."""
    found = rows.groupBy("raw_hash").agg(F.min("question_id").alias("kept_id"), F.count("*").alias("copies"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return found.select("raw_hash", "kept_id", "copies", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))


def deduplicate(rows: DataFrame, position: str | None = None) -> DataFrame:
    """One row of each text without a label conflict; the whole group goes where labels differ.

    The row of the smallest (question_id, ``position``) stays. Without a position, or where it repeats, rows of
    one id are told apart by all their columns, so the choice is the same in each run.
    """
    names, tie = rows.columns, free_name(rows, "_tie")
    order = F.struct("question_id", *([F.col(position)] if position else []), F.xxhash64(*named(names)))
    keyed = rows.withColumn(tie, order)
    kept = keyed.groupBy("raw_hash").agg(F.min(tie).alias(tie), F.min("label").alias("lo"), F.max("label").alias("hi")).where("not coalesce(lo <> hi, false)").select("raw_hash", tie)
    return keyed.join(kept, ["raw_hash", tie], "left_semi").dropDuplicates(["raw_hash", tie]).select(*named(names))


def conflicting(rows: DataFrame) -> DataFrame:
    """The rows of texts that have different labels."""
    return rows.join(duplicate_groups(rows).where("conflict").select("raw_hash"), "raw_hash", "left_semi")


def class_counts(rows: DataFrame, label: str = "label") -> dict[str, int]:
    return {r["label"]: r["n"] for r in rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}  # a row a class


def check_training(rows: DataFrame, min_records: int, min_class_count: int) -> dict[str, int]:
    """Counts by class; raises if there are too few records, in all or of a class, or if an id comes twice."""
    counts = class_counts(rows)
    n = sum(counts.values())
    if n < min_records:
        raise ValueError(f"record_count_below_min:{n}<{min_records}")
    if set(counts) - set(CLASSES):
        raise ValueError("invalid_label")
    missing = [c for c in CLASSES if not counts.get(c)]
    if missing:
        raise ValueError(f"missing_classes:{missing}")
    low = {c: k for c, k in counts.items() if k < min_class_count}
    if low:
        raise ValueError(f"class_minimum:{low}")
    if rows.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("duplicate_question_id_after_dedup")
    return counts


def split_balance(rows: DataFrame, min_class_count: int = 1) -> DataFrame:
    """(split, label, n, enough) for each of the nine pairs, also those without rows."""
    spark = rows.sparkSession
    full = spark.createDataFrame([(s, c) for s in ("train", "validation", "test") for c in CLASSES], "split string, label string")
    n = rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    found = full.join(n, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"))
    return found.withColumn("enough", F.col("n") >= min_class_count)


def check_splits(rows: DataFrame, min_class_count: int = 1) -> None:
    low = split_balance(rows, min_class_count).where("not enough").orderBy("split", "label").collect()  # nine rows at most
    if low:
        raise ValueError(f"split_missing_or_low_classes:{[(r['split'], r['label']) for r in low]}")


def class_weights(rows: DataFrame, label: str = "label", balanced_below: float = 1.5) -> DataFrame:
    """(label, n, weight): N / (3 n), or 1 where the classes are within that ratio."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), (F.max("n") / F.min("n")).alias("ratio"))  # one row
    weight = F.when(F.col("ratio") <= balanced_below, 1.0).otherwise(F.col("total") / (len(CLASSES) * F.col("n")))
    return n.join(F.broadcast(total), F.lit(True)).select(label, "n", F.round(weight, 9).alias("weight"))
