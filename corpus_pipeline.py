"""Documents to packed training sequences: quality filter, near-dedup, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row of ``docs``; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them as the next one's. Nulls, empty and repeated
rows, empty tables and extra columns of any name are handled as the operators say; extra columns pass the
first three stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, quality, simhash
from corpusmill.session import cut, named, table

#: A document goes only if it is likelier bad than good.
REJECT_BELOW = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score ``REJECT_BELOW`` or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), REJECT_BELOW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row per copy: ranges of the shards' shuffled orders, dealt to tasks and written in order."""
    mixed = mixing.mix(docs)
    shard, order = named(mixed.columns[-2:])
    return mixed.repartition(shard, F.shiftright(order, 56)).sortWithinPartitions(shard, order).select(*named(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its token ids and its place in a training sequence."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("source_mix", source_mix), ("pack", pack)]

#: SQL has no fingerprints, discriminants or tokenizers; tests/llm compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
