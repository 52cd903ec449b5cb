"""Prediction from a saved run: nothing is fitted, and a run whose files or schema have changed is refused."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import files
from corpusmill.lexicons import CLASSES
from corpusmill.operators import bundle as bundles
from corpusmill.operators.learners import Model
from corpusmill.operators.records import with_identity
from corpusmill.operators.transform import Scaler
from corpusmill.registry import check_schema

_KINDS = {"baseline_logistic": LogisticRegressionModel, "baseline_rf": RandomForestClassificationModel}


def resolve_profile(semantic: bool, parser: bool, readability: bool, parquet: bool = True, requested: str | None = "auto", missing: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """(profile, reasons): P0 with all four, P1 to P3 without the first, second or third alone, P4 without two or more of
    those three; ``BLOCKED`` if a needed package is missing, for other combinations, and for a requested profile
    whose own needs are not met. P0 and auto take what is there."""
    if missing:
        return "BLOCKED", sorted(missing)
    lacks = (not semantic, not parser, not readability, not parquet)
    single = {(False, False, False, False): "P0", (True, False, False, False): "P1", (False, True, False, False): "P2", (False, False, True, False): "P3"}
    detected = single.get(lacks) or ("P4" if sum(lacks[:3]) >= 2 else None)
    if detected is None:
        return "BLOCKED", ["unsupported_dependency_combination"]
    if requested in ("auto", None, "", "P0"):
        return detected, []
    needs = {"P1": (parser, readability, parquet), "P2": (semantic, readability, parquet), "P3": (semantic, parser, parquet), "P4": ()}
    if requested not in needs:
        raise ValueError(f"unknown_dependency_profile:{requested}")
    return (requested, []) if all(needs[requested]) else ("BLOCKED", [f"requested_profile_incompatible:{requested}"])


def probability_map(probability: str = "probability") -> Column:
    """Class -> probability for all three classes, whichever the model knows."""
    pairs = []
    for i, c in enumerate(CLASSES):
        pairs += [F.lit(c), F.coalesce(F.get(probability, F.lit(i)), F.lit(0.0))]
    return F.create_map(*pairs)


def answers(predicted: DataFrame, metadata: dict) -> DataFrame:
    """(question_id, predicted_label, probabilities, model_confidence, metadata columns) from ``probability`` and ``p``."""
    label = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("p") + 1)
    return predicted.select("question_id", label.alias("predicted_label"), probability_map().alias("probabilities"), F.array_max("probability").alias("model_confidence"), *(F.lit(v).alias(k) for k, v in metadata.items()))


def save_model(model: Model, spark: SparkSession, folder: str) -> None:
    for i, m in enumerate(model.classifiers):
        m.write().overwrite().save(f"{folder}/model/{i}")
    scaler = vars(model.scaler) if model.scaler else None
    files.write_json(spark, f"{folder}/model.json", {"run_id": model.run_id, "columns": model.columns, "classifiers": len(model.classifiers), "scaler": scaler, "calibrators": model.calibrators, "params": model.params})


def load_model(spark: SparkSession, folder: str) -> Model:
    plain = files.read_json(spark, f"{folder}/model.json")
    kind = _KINDS.get(plain["run_id"], GBTClassificationModel)
    parts = [kind.load(f"{folder}/model/{i}") for i in range(plain["classifiers"])]
    return Model(plain["run_id"], plain["columns"], parts, Scaler(**plain["scaler"]) if plain["scaler"] else None, plain["calibrators"], plain["params"])


class Predictor:
    """A run's bundle and model. One record and many go the same way, so their answers are equal."""

    def __init__(self, spark: SparkSession, folder: str):
        manifest = files.read_json(spark, f"{folder}/run_manifest.json")
        files.verify_hashes(spark, folder, manifest["artifact_checksums"])
        saved = files.read_json(spark, f"{folder}/feature_schema.json")
        check_schema(saved)
        self.spark, self.bundle, self.model = spark, bundles.load(spark, folder), load_model(spark, folder)
        if saved["columns"] != self.model.columns:
            raise ValueError(f"inference_dimension_mismatch:{len(saved['columns'])}!={len(self.model.columns)}")
        self.metadata = {"calibrated": bool(manifest["calibrated"]), "model_version": manifest["model_version"], "feature_schema_version": saved["version"], "dependency_profile": manifest["dependency_profile"]}

    def predict(self, questions: DataFrame, extras: bundles.Extras | None = None) -> DataFrame:
        """Answers for questions(question[, question_id]); ids that are missing come from the text."""
        rows = with_identity(questions, supplied="question_id" if "question_id" in questions.columns else None).select("question_id", "question")
        matrix, _ = bundles.apply(self.bundle, rows, extras)
        return answers(self.model.predict(matrix), self.metadata)
