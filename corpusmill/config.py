"""Run configuration: defaults, YAML files with overrides on top, and the checks before a run."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path

# The published defaults.
DEFAULTS = {
    "corpus": {"min_records": 10000, "path": None},
    "ingest": {"max_reject_ratio": 0.02},
    "validation": {"min_class_count": 30},
    "dedup": {"near_threshold": 0.85, "minhash_permutations": 128, "lsh_bands": 32},
    "split": {"ratios": [0.70, 0.15, 0.15], "max_ratio_deviation": 0.02, "small_dataset_threshold": 5000},
    "preprocess": {"max_chars": 20000, "sentence_abbreviations": ["e.g.", "i.e.", "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "fig.", "eq.", "no.", "approx.", "inc.", "dept."]},
    "features": {"use_lexical": True, "use_readability": True, "use_syntax": True, "use_task": True, "use_mcq": True, "use_tfidf": True, "use_semantic_scalar": True, "use_programming": True, "use_semantic_embedding": True, "rare_word_df_threshold": 5, "tfidf_high_percentile": 90, "max_sentences_for_f29": 40, "recursion_weight": 2, "indent_width": 4},
    "semantic": {"pca_components": 48, "min_explained_variance": 0.60},
    "selection": {"correlation_threshold": 0.90},
    "training": {"calibrate": False, "hyperparameter_search": True},
    "interpret": {"shap_sample_size": 2000},
    "seed": {"split": 42, "minhash": 42, "pca": 42, "model": 42, "cv": 42, "permutation_importance": 42, "shap_sample": 42},
    "runtime": {"dependency_profile": "P0"},
}


def merged(base: Mapping, over: Mapping | None) -> dict:
    """``base`` with the values of ``over`` in place of its own, section by section; both stay as they are."""
    out = copy.deepcopy(dict(base))
    for name, value in (over or {}).items():
        both = isinstance(value, Mapping) and isinstance(out.get(name), Mapping)
        out[name] = merged(out[name], value) if both else copy.deepcopy(value)
    return out


def load(path: str | Path | None = None, override: Mapping | None = None) -> dict:
    """Defaults, then the YAML file, then ``override``; checked."""
    import yaml

    own = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}) if path else {}
    config = merged(merged(DEFAULTS, own), override)
    validate(config)
    return config


def validate(config: Mapping) -> None:
    """Raises ``ValueError`` for the first of these that does not hold."""
    missing = [s for s in DEFAULTS if s not in config]
    if missing:
        raise ValueError(f"missing_config_sections:{missing}")
    ratios = [float(x) for x in config["split"]["ratios"]]
    words = config["preprocess"].get("sentence_abbreviations", [])
    checks = {
        "corpus.min_records_must_be_positive": int(config["corpus"]["min_records"]) >= 1,
        "split.ratios_must_sum_to_one": len(ratios) == 3 and abs(sum(ratios) - 1) <= 1e-9,
        "dedup.near_threshold_out_of_range": 0 < float(config["dedup"]["near_threshold"]) <= 1,
        "semantic.pca_components_must_be_positive": int(config["semantic"]["pca_components"]) >= 1,
        "selection.correlation_threshold_out_of_range": 0 < float(config["selection"]["correlation_threshold"]) < 1,
        "preprocess.max_chars_must_be_positive": int(config["preprocess"]["max_chars"]) > 0,
        "preprocess.sentence_abbreviations_must_be_string_list": isinstance(words, list) and all(isinstance(w, str) for w in words),
        "ingest.max_reject_ratio_out_of_range": 0 <= float(config["ingest"]["max_reject_ratio"]) <= 1,
        "missing_seed_keys": DEFAULTS["seed"].keys() <= config["seed"].keys(),
    }
    for reason, holds in checks.items():
        if not holds:
            raise ValueError(reason)
