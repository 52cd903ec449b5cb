"""Feature matrices fitted on training rows and applied to others: views, features, imputing, one-hot columns,
components of an embedding, selection. What is fitted is tables and plain values, and is saved as such."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from corpusmill import config as configuration
from corpusmill import files
from corpusmill.lexicons import Lexicons
from corpusmill.operators import features
from corpusmill.operators.features import Fitted, TfIdf
from corpusmill.operators.quantiles import medians
from corpusmill.operators.transform import Components, all_missing, apply_medians, assemble, check_finite, fit_components, one_hot, uncorrelated
from corpusmill.registry import CATEGORIES, FEATURES, ONE_HOT, active_features, numeric_columns, schema
from corpusmill.session import cut, named


@dataclass
class Extras:
    """Optional tables: syntax(question_id, F09..F13), similarity(question_id, F21, F22, F29), embedding(question_id, embedding)."""

    syntax: DataFrame | None = None
    similarity: DataFrame | None = None
    embedding: DataFrame | None = None


@dataclass
class Bundle:
    profile: str
    config: dict
    lexicons: Lexicons
    fitted: Fitted
    medians: dict[str, float]
    numeric: list[str]
    engineered: list[str]
    full: list[str]
    final: list[str]
    components: Components | None
    active: list[str]

    def schema(self, columns: list[str]) -> dict:
        return schema(columns, self.profile)


def _rows(records: DataFrame, fitted: Fitted, lexicons: Lexicons, settings: dict, extras: Extras, views: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assembled features of the records, audit rows)."""
    views = features.views_of(records, lexicons, settings["preprocess"]) if views is None else views
    found = cut(features.extract(views, fitted, lexicons, settings["features"], extras.syntax, extras.similarity), "features")
    keep = [c for c in ("split", "label") if c in records.columns]
    audit = found.select("question_id", "semantic_truncated", "code_parse_exact", "code_detection_tiers", "mcq_detection_tier")
    rows = assemble(found)
    return (rows.join(records.select("question_id", *keep), "question_id") if keep else rows), audit


def _matrix(rows: DataFrame, values: dict[str, float], categories: bool, components: Components | None, extras: Extras) -> DataFrame:
    rows = apply_medians(rows, values)
    if categories:
        for f, known in CATEGORIES.items():
            rows = one_hot(rows, f, known, FEATURES[f])
    if components is not None:
        rows = components(rows.join(extras.embedding.select("question_id", "embedding"), "question_id", "left")).drop("embedding")
    return rows


def fit(records: DataFrame, profile: str, settings: dict | None = None, lexicons: Lexicons | None = None, extras: Extras | None = None, active: list[str] | None = None) -> tuple[Bundle, DataFrame, DataFrame]:
    """(bundle, matrix, audit rows) of records(question_id, question, label, split); everything is fitted on the rows of
    split ``train``. In order: artifacts, features, columns without any training value dropped, medians, one-hot columns,
    components, selection. ``active`` None means the profile's features, an empty list none, which is an error.
    """
    settings, lexicons, extras = settings or configuration.DEFAULTS, lexicons or Lexicons(), extras or Extras()
    switches = settings["features"]
    views = features.views_of(records, lexicons, settings["preprocess"])
    fitted = features.fit(views.where("split = 'train'"), switches=switches)
    rows, audit = _rows(records, fitted, lexicons, settings, extras, views)
    active = active_features(profile, switches) if active is None else active
    numeric = numeric_columns(active)
    if not numeric:
        raise ValueError("no_active_numeric_features")
    train = rows.where("split = 'train'")
    lost = set(all_missing(train, numeric))
    numeric = [c for c in numeric if c not in lost]
    if not numeric:
        raise ValueError("all_numeric_features_missing")
    values = {c: v for c, v in medians(train, numeric).items() if v is not None}
    categories = any(f in active for f in CATEGORIES)
    engineered = numeric + (ONE_HOT if categories else [])
    components = None
    if switches.get("use_semantic_embedding", True) and extras.embedding is not None:
        own = train.select("question_id").join(extras.embedding, "question_id")
        components = fit_components(own, "embedding", int(settings["semantic"]["pca_components"]))
    full = engineered + ([f"sem_pca_{i:03d}" for i in range(len(components.axes))] if components else [])
    matrix = cut(_matrix(rows, values, categories, components, extras).select("question_id", "split", "label", *named(full)), "matrix")
    final = uncorrelated(matrix.where("split = 'train'"), full, float(settings["selection"]["correlation_threshold"]))
    check_finite(matrix, full)
    return Bundle(profile, settings, lexicons, fitted, values, numeric, engineered, full, final, components, active), matrix, audit


def apply(bundle: Bundle, records: DataFrame, extras: Extras | None = None) -> tuple[DataFrame, DataFrame]:
    """(matrix, audit rows) of other records; nothing is fitted."""
    extras = extras or Extras()
    rows, audit = _rows(records, bundle.fitted, bundle.lexicons, bundle.config, extras)
    categories = any(c in bundle.full for c in ONE_HOT)
    keep = [c for c in ("split", "label") if c in rows.columns]
    out = cut(_matrix(rows, bundle.medians, categories, bundle.components, extras).select("question_id", *keep, *named(bundle.full)), "matrix")
    check_finite(out, bundle.full, "transformed_feature_matrix_contains_nan_or_inf")
    return out, audit


def save(bundle: Bundle, spark: SparkSession, folder: str) -> None:
    """Tables as Parquet, the rest as one JSON file."""
    bundle.fitted.rare_df.write.mode("overwrite").parquet(f"{folder}/rare_word_df")
    plain = {"profile": bundle.profile, "config": bundle.config, "lexicons": asdict(bundle.lexicons), "medians": bundle.medians, "numeric_columns": bundle.numeric, "engineered_columns": bundle.engineered, "full_columns": bundle.full, "final_columns": bundle.final, "active_feature_ids": bundle.active}
    if bundle.fitted.tfidf is not None:
        bundle.fitted.tfidf.vocabulary.write.mode("overwrite").parquet(f"{folder}/tfidf_vocabulary")
        plain["tfidf_threshold"] = bundle.fitted.tfidf.threshold
    if bundle.components is not None:
        plain["components"] = {"mean": bundle.components.mean.tolist(), "axes": bundle.components.axes.tolist(), "ratios": bundle.components.ratios.tolist()}
    files.write_json(spark, f"{folder}/preprocessing.json", plain)


def load(spark: SparkSession, folder: str) -> Bundle:
    plain = files.read_json(spark, f"{folder}/preprocessing.json")
    tfidf = TfIdf(spark.read.parquet(f"{folder}/tfidf_vocabulary"), plain["tfidf_threshold"]) if "tfidf_threshold" in plain else None
    parts = plain.get("components")
    components = Components(*(np.array(parts[k]) for k in ("mean", "axes", "ratios"))) if parts else None
    return Bundle(plain["profile"], plain["config"], Lexicons(**plain["lexicons"]), Fitted(spark.read.parquet(f"{folder}/rare_word_df"), tfidf), plain["medians"], plain["numeric_columns"], plain["engineered_columns"], plain["full_columns"], plain["final_columns"], components, plain["active_feature_ids"])
