"""The feature schema: names, families, indicators, which are active, and the schema's hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from corpusmill.lexicons import INSTRUCTION_TYPES, QUESTION_TYPES

# Feature names by family, in order; indicators; versions.
FAMILIES = {
    "lexical": {"F01": "word_count", "F02": "avg_sentence_length", "F03": "avg_word_length", "F04": "type_token_ratio", "F05": "rare_word_ratio"},
    "readability": {"F06": "flesch_reading_ease", "F07": "flesch_kincaid_grade", "F08": "gunning_fog"},
    "syntax": {"F09": "clause_count", "F10": "avg_noun_phrase_length", "F11": "parse_tree_depth", "F12": "dependency_complexity", "F13": "negation_count"},
    "task": {"F14": "question_type", "F15": "instruction_type", "F16": "cognitive_demand", "F17": "subquestion_count"},
    "mcq": {"F18": "option_count", "F19": "avg_option_length", "F20": "option_length_variance", "F21": "stem_option_similarity_mean", "F22": "option_option_similarity_mean"},
    "tfidf": {"F23": "mean_tfidf", "F24": "max_tfidf", "F25": "high_tfidf_term_count"},
    "semantic_scalar": {"F26": "concept_count", "F27": "concept_density", "F28": "technical_term_ratio", "F29": "semantic_similarity"},
    "programming": {"F30": "algorithm_or_ds_complexity", "F31": "max_input_size_log", "F32": "constraint_count", "F33": "code_length", "F34": "cyclomatic_complexity", "F35": "loop_nesting_complexity"},
}
INDICATORS = ["mcq_detected", "code_detected", "input_size_detected", "parse_ok", "multi_segment"]
FEATURE_VERSION, EXTRACTOR_VERSION = "fs_v3", "extractor_v3"
#: What a disabled family's columns hold; all others hold null.
DISABLED = {"F14": "Other", "F15": "Other", "F16": 1, "F17": 0, "F18": 0, "F25": 0}
#: Features that a profile goes without.
LOST = {"P0": [], "P1": ["F21", "F22", "F29"], "P2": list(FAMILIES["syntax"]), "P3": list(FAMILIES["readability"]), "P4": ["F21", "F22", "F29", *FAMILIES["syntax"]]}

FEATURES = {f: n for members in FAMILIES.values() for f, n in members.items()}
FAMILY_OF = {f: family for family, members in FAMILIES.items() for f in members}
CATEGORIES = {"F14": QUESTION_TYPES, "F15": INSTRUCTION_TYPES}
ONE_HOT = [f"{FEATURES[f]}={v}" for f, values in CATEGORIES.items() for v in values]
#: An indicator stays while one of these features does.
GOVERNED_BY = {"mcq_detected": list(FAMILIES["mcq"]), "code_detected": list(FAMILIES["programming"]), "input_size_detected": ["F31", "F32"], "parse_ok": list(FAMILIES["syntax"]), "multi_segment": ["F29"]}


def active_features(profile: str, switches: dict | None = None) -> list[str]:
    """Features of the profile and of the families that are switched on, in order."""
    switches = switches or {}
    lost = set(LOST[profile]) | (set(LOST["P1"]) if not switches.get("use_semantic_embedding", True) else set())
    return [f for f, family in FAMILY_OF.items() if f not in lost and switches.get(f"use_{family}", True)]


def active_indicators(active: Iterable[str]) -> list[str]:
    return [i for i in INDICATORS if not set(GOVERNED_BY[i]).isdisjoint(active)]


def numeric_columns(active: Iterable[str]) -> list[str]:
    """Active numbers and indicators, in order; the two categories become one-hot columns instead."""
    active = list(active)
    return [f for f in FEATURES if f in active and f not in CATEGORIES] + active_indicators(active)


def family_columns(columns: Iterable[str], families: Iterable[str]) -> list[str]:
    """The columns of these families: features, one-hot columns, indicators, principal components."""
    families, out = set(families), []
    indicator_family = {"mcq_detected": "mcq", "code_detected": "programming", "input_size_detected": "programming", "parse_ok": "syntax", "multi_segment": "semantic_scalar"}
    for c in columns:
        family = FAMILY_OF.get(c) or indicator_family.get(c) or ("task" if c in ONE_HOT else "semantic_embedding" if c.startswith("sem_pca_") else None)
        if family in families:
            out.append(c)
    return out


def json_hash(value) -> str:
    """SHA-256 of the value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8")).hexdigest()


def schema(columns: list[str], profile: str, dtypes: list[str] | None = None) -> dict:
    """What a model's input looks like; ``schema_hash`` covers all the rest."""
    found = {
        "version": FEATURE_VERSION, "columns": list(columns), "dtypes": list(dtypes or ["float64"] * len(columns)), "missing_sentinels": dict.fromkeys(FEATURES, "NaN"),
        "family_map": {k: list(v) for k, v in FAMILIES.items()}, "indicators": INDICATORS, "extractor_versions": {"FeatureExtractor": EXTRACTOR_VERSION}, "profile": profile,
    }
    return found | {"schema_hash": json_hash(found)}


def check_schema(saved: dict) -> None:
    """Raises if the schema was made by another extractor or does not hash to what it says."""
    if saved.get("extractor_versions", {}).get("FeatureExtractor") != EXTRACTOR_VERSION:
        raise ValueError(f"extractor_version_mismatch:{saved.get('extractor_versions')}")
    actual = json_hash({k: v for k, v in saved.items() if k in schema([], "P0") and k != "schema_hash"})
    if actual != saved["schema_hash"]:
        raise ValueError(f"schema_hash_mismatch:{saved['schema_hash']}!={actual}")
