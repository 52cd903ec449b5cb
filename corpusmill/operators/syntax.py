"""Syntax features over a table of parsed tokens, which a parser outside this package supplies.

``tokens(question_id, sent_no, i, text, lemma, dep, head_i, is_punct, is_space)``, ``i`` and ``head_i`` counting within the text and
a root being its own head; ``chunks(question_id, start, end)``: noun phrases, ``end`` exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import fold
from corpusmill.lexicons import CLAUSE_HEADS, NEGATIONS
from corpusmill.session import cut

#: Hops to the root that are counted at most.
DEEPEST = 100


def word_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens that are words: neither punctuation nor space, with a letter or digit."""
    return tokens.where(~F.col("is_punct") & ~F.col("is_space") & F.col("text").rlike(r"[\p{L}\p{N}]"))


def tree_depths(tokens: DataFrame) -> DataFrame:
    """(question_id, depth): the most hops from a token to its root, ``DEEPEST`` at most.

    By pointer doubling: after k rounds a token knows its ancestor 2^k hops up and how far that is, so seven joins do.
    Broken heads (a cycle, or none) count as ``DEEPEST`` and as roots.
    """
    keys = ["question_id", "sent_no"]
    up = cut(tokens.select(*keys, "i", F.coalesce("head_i", "i").alias("to"), (F.coalesce("head_i", "i") != F.col("i")).cast("int").alias("hops")), "parse-heads")
    for _ in range((DEEPEST - 1).bit_length()):
        above = up.select(*keys, F.col("i").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("more"))
        up = cut(up.join(above, [*keys, "to"], "left").select(*keys, "i", F.coalesce("to2", "to").alias("to"), F.least(F.col("hops") + F.coalesce("more", F.lit(0)), F.lit(DEEPEST)).alias("hops")), "parse-heads")
    return up.groupBy("question_id").agg(F.max("hops").alias("depth"))


def features(tokens: DataFrame, chunks: DataFrame, clause_heads: list[str] = CLAUSE_HEADS, negations: list[str] = NEGATIONS) -> DataFrame:
    """(question_id, F09..F13) for each parsed text.

    Clause heads; mean words of a noun phrase (0 without one); depth of the deepest tree; mean over sentences of two
    tokens or more of the distance to the head by token less one (null without such a sentence); negations, by
    dependency or by word, a token once.
    """
    per_sentence = tokens.groupBy("question_id", "sent_no").agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("i") - F.coalesce("head_i", "i"))).alias("reach"),
        F.sum((F.coalesce("head_i", "i") != F.col("i")).cast("int")).alias("below"),
        F.sum(F.lower("dep").isin([c.lower() for c in clause_heads]).cast("int")).alias("clauses"),
        F.sum((F.coalesce(F.lower("dep") == "neg", F.lit(False)) | F.coalesce(fold(F.col("text")).isin([w.casefold() for w in negations]), F.lit(False))).cast("int")).alias("negations"),
    )
    distance = F.when((F.col("n") >= 2) & (F.col("below") >= 1), F.col("reach") / (F.col("n") - 1))
    per_text = per_sentence.groupBy("question_id").agg(F.coalesce(F.sum("clauses"), F.lit(0)).alias("F09"), F.avg(distance).alias("F12"), F.sum("negations").alias("F13"))
    phrases = chunks.groupBy("question_id").agg(F.avg(F.col("end") - F.col("start")).alias("F10"))
    depths = tree_depths(tokens).withColumnRenamed("depth", "F11")
    found = per_text.join(phrases, "question_id", "left").join(depths, "question_id", "left")
    return found.select("question_id", "F09", F.coalesce("F10", F.lit(0.0)).alias("F10"), "F11", "F12", "F13")
