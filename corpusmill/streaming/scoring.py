"""Text features of questions as they arrive: stateless, so a stream and a table give equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.lexicons import ALGORITHMS, CONCEPTS, TECHNICAL


def question_features(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds f01, sentences, f18, f26, f30 and technical to ``questions``, streaming or not."""
    return questions.select(
        "*",
        F.size(T.words(text)).alias("f01"),
        F.size(T.sentences(F.col(text))).alias("sentences"),
        F.size(T.options(F.col(text))).alias("f18"),
        T.distinct_phrases(text, CONCEPTS).alias("f26"),
        T.weighted_phrase_max(text, ALGORITHMS).alias("f30"),
        T.phrase_occurrences(text, TECHNICAL).alias("technical"),
    )


def read_questions(spark: SparkSession, folder: str, schema: str = "question_id string, question string", files: int = 1000) -> DataFrame:
    """New JSON-lines files of ``folder``, ``files`` a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def score_folder(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Scores what ``folder`` holds and stops; run again, it goes on from ``checkpoint``."""
    scored = question_features(read_questions(spark, folder))
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
