"""Embedding units of question views, an encoder of the user's own behind a cache table, and similarities of units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import files
from corpusmill.functions.text import cosine

MOST_SENTENCES = 40


def units(views: DataFrame, key: str = "question_id", most_sentences: int = MOST_SENTENCES) -> DataFrame:
    """(key, role, pos, text): the question; with options its stem and each of them; its first sentences."""
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), F.lit(0).alias("pos"), text.alias("text")))
    many = lambda role, texts: F.transform(texts, lambda t, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), t.alias("text")))
    none = F.expr("cast(array() as array<struct<role: string, pos: int, text: string>>)")
    stem = F.when(F.size("view.options") > 0, one("stem", F.col("view.nl_stem"))).otherwise(none)
    rows = F.concat(one("question", F.col("view.nl_view")), stem, many("option", F.col("view.options")), many("sentence", F.slice("view.sentences", 1, most_sentences)))
    return views.select(key, F.inline(rows))


def cache_key(key: str, model: str, revision: str, longest: int = 256) -> Column:
    """Changes with the record, the role and place in it, the text and the encoder."""
    role = F.when(F.col("role").isin("option", "sentence"), F.concat_ws(":", "role", "pos")).otherwise(F.col("role"))
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), role, F.sha2("text", 256), F.lit(model), F.lit(revision), F.lit(str(longest))), 256)


def encode(found: DataFrame, encoder: Callable[[list[str]], np.ndarray], cache: str, key: str = "question_id", model: str = "own", revision: str = "configured", batch: int = 64) -> DataFrame:
    """(key, role, pos, embedding) of units. Vectors are unit length; those in the table at ``cache`` are read, others encoded
    and added to it. ``encoder`` maps texts to rows and runs in the workers, ``batch`` texts at a time."""
    spark: SparkSession = found.sparkSession
    keyed = found.withColumn("cache_key", cache_key(key, model, revision))

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        out = []
        for at in range(0, len(texts), batch):
            x = np.asarray(encoder(list(texts.iloc[at : at + batch])), float)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            out += list((x / np.where(size == 0, 1, size)).astype(np.float32))
        return pd.Series(out)

    todo = keyed
    if files.exists(spark, cache):
        todo = keyed.join(spark.read.parquet(cache).select("cache_key"), "cache_key", "left_anti")
    todo.select("cache_key", "text").dropDuplicates(["cache_key"]).select("cache_key", run("text").alias("embedding")).write.mode("append").parquet(cache)
    known = spark.read.schema("cache_key string, embedding array<float>").parquet(cache).dropDuplicates(["cache_key"])
    return keyed.join(known, "cache_key").select(key, "role", "pos", "embedding")


def _unit_vector(v: str) -> Column:
    x = F.transform(v, lambda a: a.cast("double"))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.when(size > 0, F.transform(x, lambda a: a / size)).otherwise(F.transform(x, lambda a: F.lit(0.0)))


def mean_pairwise(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(key, name): mean cosine over all pairs of a key's vectors, from the length of their sum, so no pair is
    made; a vector without length has cosine 0 with any other. Null below two vectors."""
    unit = rows.select(key, _unit_vector(vector).alias("u"))
    sums = unit.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("k"))
    out = sums.groupBy(key).agg(F.sum(F.col("t") * F.col("t") - F.col("own")).alias("both"), F.max("k").alias("k"))
    return out.select(key, F.when(F.col("k") >= 2, F.col("both") / (F.col("k") * (F.col("k") - 1.0))).alias(name))


def similarities(vectors: DataFrame, key: str = "question_id", most_sentences: int = MOST_SENTENCES) -> DataFrame:
    """(key, F21, F22, F29) from (key, role, pos, embedding): stem with options, options with one another, sentences."""
    options, stems = vectors.where("role = 'option'"), vectors.where("role = 'stem'").select(key, F.col("embedding").alias("stem"))
    with_stem = options.join(stems, key).groupBy(key).agg(F.avg(cosine(F.col("stem"), F.col("embedding"))).alias("F21"))
    among = mean_pairwise(options, key, "embedding", "F22")
    own = mean_pairwise(vectors.where((F.col("role") == "sentence") & (F.col("pos") < most_sentences)), key, "embedding", "F29")
    ids = vectors.select(key).distinct()
    return ids.join(with_stem, key, "left").join(among, key, "left").join(own, key, "left")
