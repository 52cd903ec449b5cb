"""Labelled records from JSON lines or a JSON array, with every bad line kept as a reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill import files
from corpusmill.functions.text import strip

#: Bytes that are looked at to tell an array from lines.
HEAD = 1 << 16


class IngestError(ValueError):
    """The corpus as a whole cannot be read."""


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is not white space is ``[``; a file of more white space than ``HEAD`` has lines."""
    return files.read_bytes(spark, files.first_file(spark, path), HEAD).decode("utf-8", "ignore").removeprefix("\ufeff").lstrip().startswith("[")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record): lines count from 1 in each file. Numbers come from the row counts of the scanned blocks,
    so no line is moved for them. A line that is not UTF-8 fails the run when it is read."""
    good = F.when(F.expr("is_valid_utf8(value)"), F.col("value")).otherwise(F.raise_error(F.lit("encoding_error")))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), good.alias("record"))


def _text_of(v: Column) -> Column:
    """A string value as it is, a whole number as its digits; else null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("STRING", "BIGINT"), F.try_variant_get(v, "$", "string"))


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _records(rows: DataFrame) -> DataFrame:
    """From (line, record, v): null ``v`` is malformed JSON."""
    v = F.col("v")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    question, label, own = (_member(v, c) for c in ("question", "label", "question_id"))
    own = _text_of(own)
    reason = F.when(v.isNull(), "malformed_json").when(~is_object, "malformed_record")
    return rows.select(
        "line", F.when(is_object & (F.schema_of_variant(question) == "STRING"), F.try_variant_get(question, "$", "string")).alias("question"), F.when(is_object, _text_of(label)).alias("raw_label"),
        F.when(is_object & ~own.isin("", "0"), own).alias("question_id"), reason.alias("reason"), "record",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(line, question, raw_label, question_id, reason, record); ``line`` counts from 1.

    Blank lines are skipped. A line that is no JSON has reason ``malformed_json``, one that is no object
    ``malformed_record``; also a key that comes twice is malformed here. A question that is no string is null; labels and
    ids may be strings or whole numbers, other values are null. An array that is malformed, or whose
    file is not UTF-8, fails the run; an empty file gives no rows; a missing one raises ``IngestError``.
    """
    if not files.exists(spark, path):
        raise IngestError(f"missing_corpus:{path}")
    if is_array(spark, path):
        whole = spark.read.text(path, wholetext=True)
        text = F.when(F.expr("is_valid_utf8(value)"), F.col("value")).otherwise(F.raise_error(F.lit("encoding_error")))
        rows = whole.select(F.posexplode(F.from_json(text, "array<variant>", {"mode": "FAILFAST"})).alias("i", "v")).select((F.col("i") + 1).cast("long").alias("line"), F.expr("to_json(v)").alias("record"), "v")
        # a null element is no object, not malformed JSON
        return _records(rows.withColumn("v", F.coalesce("v", F.parse_json(F.lit("null")))))
    rows = numbered_lines(spark, path).where(strip(F.col("record")) != "").select("line", "record", F.try_parse_json("record").alias("v"))
    return _records(rows)


def write_rejects(rows: DataFrame, path: str, conflicts: DataFrame | None = None) -> None:
    """``line, reason, record`` of the rows with a reason, as JSON lines; then the records of groups of equal
    questions with different labels, without a line."""
    bad = rows.where("reason is not null").select(F.col("line").cast("long").alias("line"), "reason", "record")
    if conflicts is not None:
        own = conflicts.select(F.lit(None).cast("long").alias("line"), F.lit("duplicate_label_conflict").alias("reason"), F.to_json(F.struct(*conflicts.columns)).alias("record"))
        bad = bad.unionByName(own)
    bad.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_selected(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(question_id, label, y) of the canonical records whose id is in ``ids(question_id)``; raises if one is missing."""
    from corpusmill.lexicons import CLASSES

    rows = spark.read.schema("question_id string, label string").json(path)
    y = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
    found = rows.join(ids.select("question_id").distinct(), "question_id", "left_semi").where(F.col("label").isin(*CLASSES)).select("question_id", "label", y.cast("int").alias("y"))
    if ids.select("question_id").join(found, "question_id", "left_anti").limit(1).count():
        raise ValueError("missing_train_validation_labels")
    return found
