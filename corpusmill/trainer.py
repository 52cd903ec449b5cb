"""A whole run: a corpus of labelled questions in, a checked, saved, once-tested model and its reports out."""

from __future__ import annotations

import datetime
import importlib.metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import config as configuration
from corpusmill import files, inference
from corpusmill.lexicons import Lexicons
from corpusmill.operators import bundle as bundles
from corpusmill.operators import learners, metrics, records, splits
from corpusmill.registry import json_hash
from corpusmill.session import cut, named
from corpusmill.sources import json_records

MODEL_VERSION = "spark_model_v1"
MARKER = "test_evaluated.marker"


def write_event(spark: SparkSession, folder: str, stage: str, severity: str, reason: str, question_id: str | None = None, **more: str) -> None:
    """A line of the run's event log, a folder of JSON files."""
    names = {"stage": stage, "severity": severity, "reason": reason, "question_id": question_id, **more}
    spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} string" for k in names)).write.mode("append").json(f"{folder}/events")


def open_test(spark: SparkSession, folder: str) -> None:
    """Says that the test rows are about to be read; from now on a second run needs to be asked for."""
    files.write_bytes(spark, f"{folder}/{MARKER}", b"started\n")


def check_untested(spark: SparkSession, folder: str, again: bool = False) -> None:
    if not again and files.exists(spark, f"{folder}/{MARKER}"):
        raise ValueError("test_already_evaluated_for_run")


def write_matrix(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """Features by split, keyed by question_id."""
    rows.select("question_id", "split", *named(columns)).write.mode("overwrite").partitionBy("split").parquet(folder)


def read_matrix(spark: SparkSession, folder: str, parts: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """The rows of these splits; other splits' files are not opened."""
    return spark.read.parquet(folder).where(F.col("split").isin(*parts))


def ingest(spark: SparkSession, path: str, settings: dict, lexicons: Lexicons, folder: str) -> DataFrame:
    """Canonical records of a corpus, with families; rejects, duplicates and conflicts are written to ``folder``."""
    read = json_records.read_records(spark, path)
    found = cut(records.with_reason(read, int(settings["preprocess"]["max_chars"]), lexicons.labels), "ingest")
    good = cut(records.with_identity(found.where("reason is null").drop("reason"), supplied="question_id"), "accepted")
    conflicts = records.conflicting(good).select("question", "label", "question_id", "raw_hash")
    json_records.write_rejects(found, f"{folder}/rejected_records", conflicts)
    records.check_reject_ratio(found, float(settings["ingest"]["max_reject_ratio"]))
    groups = cut(records.duplicate_groups(good), "groups")
    groups.where("copies > 1").write.mode("overwrite").json(f"{folder}/duplicate_report")
    n = groups.agg(F.count("*").alias("groups"), F.sum(F.col("conflict").cast("int")).alias("conflicts")).first()
    files.write_json(spark, f"{folder}/duplicate_summary.json", {"groups": n["groups"], "conflicts": n["conflicts"] or 0})
    kept = cut(records.deduplicate(good, "line").select("question", "label", "question_id", "raw_hash"), "canonical")
    records.check_training(kept, int(settings["corpus"]["min_records"]), int(settings["validation"]["min_class_count"]))
    near = settings["dedup"]
    return cut(splits.with_families(kept, hashes=int(near["minhash_permutations"]), bands=int(near["lsh_bands"]), threshold=float(near["near_threshold"])), "families")


def train(spark: SparkSession, corpus: str, folder: str, override: dict | None = None, lexicons: Lexicons | None = None, extras: bundles.Extras | None = None, tried: list[dict] | None = None, trees: int = 500, rounds: int = 40, again: bool = False, profile: str | None = None, interpret: bool = True) -> dict:
    """Runs everything and returns the manifest. ``tried``: settings of boosted trees, the whole grid by default."""
    settings, lexicons, extras = configuration.load(override=override), lexicons or Lexicons(), extras or bundles.Extras()
    check_untested(spark, folder, again)
    profile = profile or inference.resolve_profile(extras.embedding is not None, extras.syntax is not None, False)[0]
    seed = settings["seed"]
    files.write_json(spark, f"{folder}/resolved_config.json", settings)
    found = ingest(spark, corpus, settings, lexicons, folder)
    split = splits.split_records(found, tuple(settings["split"]["ratios"]), int(seed["split"]), int(seed["cv"]), float(settings["split"]["max_ratio_deviation"]), int(settings["split"]["small_dataset_threshold"]))
    rows = cut(split.records, "split")
    if split.folds is None:
        records.check_splits(rows, int(settings["validation"]["min_class_count"]))
    elif rows.where("split = 'test'").select("label").distinct().count() < 3:
        raise ValueError("test_split_missing_class")
    rows.write.mode("overwrite").json(f"{folder}/canonical")
    files.write_json(spark, f"{folder}/split_info.json", split.info)

    with_y = lambda m: m.withColumn("y", records.label_number("label"))
    fit_rows = rows.where("split <> 'test'")
    bundle, matrix, audit = bundles.fit(fit_rows, profile, settings, lexicons, extras)
    matrix = with_y(matrix)
    if split.folds is None:
        parts = matrix.where("split = 'train'"), matrix.where("split = 'validation'")
        choice = learners.select(*parts, learners.candidates(bundle.engineered, bundle.final, int(seed["model"]), tried, trees, rounds))
        base, held = parts
    else:
        pairs, plans = [], []
        pool = rows.where("split = 'train'").drop("split").withColumnRenamed("family_id", "family")
        for r in split.folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect():  # fifteen
            own = splits.fold_rows(pool, split.folds).where((F.col("repeat") == r["repeat"]) & (F.col("fold") == r["fold"])).drop("repeat", "fold")
            b, m, _ = bundles.fit(cut(own, "fold"), profile, settings, lexicons, extras)
            pairs.append((with_y(m).where("split = 'train'"), with_y(m).where("split = 'validation'")))
            plans.append(learners.candidates(b.engineered, b.final, int(seed["model"]), tried, trees, rounds))
        choice = learners.select_by_folds(pairs, lambda i: plans[i])
        choice.fit = dict(learners.candidates(bundle.engineered, bundle.final, int(seed["model"]), tried, trees, rounds))[choice.run_id]
        # calibration and importance use rows out of the model's fit: the first fold's
        first = cut(split.folds.where("repeat = 0 and fold = 0").select(F.col("family").alias("family_id")), "first-fold")
        keyed = matrix.join(rows.select("question_id", "family_id"), "question_id")
        held = keyed.join(first, "family_id", "left_semi").drop("family_id")
        base = keyed.join(first, "family_id", "left_anti").drop("family_id")
    calibrate = bool(settings["training"].get("calibrate"))
    if calibrate:
        weight, _, _ = learners.weight_column(base)
        model = learners.calibrate(choice.fit(base, weight), held)
    else:
        model = learners.refit(choice, base, held)
    ratio = learners.weight_column(matrix.where("split = 'train'"))
    bundles.save(bundle, spark, folder)
    inference.save_model(model, spark, folder)
    saved = bundle.schema(model.columns)
    files.write_json(spark, f"{folder}/feature_schema.json", saved | {"production_matrix": "engineered" if model.columns == bundle.engineered else "final"})
    files.write_json(spark, f"{folder}/full_feature_schema.json", bundle.schema(bundle.full))

    open_test(spark, folder)
    test, test_audit = bundles.apply(bundle, rows.where("split = 'test'"), extras)
    test = with_y(test)
    scored = model.predict(test)
    payload = {"candidate_runs": choice.runs, "selected_run_id": choice.run_id, "production": {"validation": next(r["validation"] for r in choice.runs if r["run_id"] == choice.run_id), "test": metrics.summary(scored.select("y", "p")).first().asDict()}}
    if calibrate:
        p = scored.select("y", *(F.get("probability", F.lit(c)).alias(f"p{c}") for c in range(3)))
        payload["production"]["test"]["brier_score"] = metrics.brier(p).first()["brier"]
    if bundle.components is not None:
        payload["semantic_pca"] = {"cumulative_explained_variance": bundle.components.explained, "warning_below_min": bundle.components.explained < float(settings["semantic"]["min_explained_variance"])}
    files.write_json(spark, f"{folder}/metrics.json", payload)
    audit.unionByName(test_audit).write.mode("overwrite").json(f"{folder}/feature_diagnostics")
    files.write_json(spark, f"{folder}/feature_importance.json", model.importances())
    files.write_json(spark, f"{folder}/shap_summary.json", learners.shap_summary())
    if interpret:
        files.write_json(spark, f"{folder}/permutation_importance.json", [r.asDict() for r in learners.permutation_importance(model, held, seed=int(seed["permutation_importance"])).collect()])
    for name, m, columns in (("full", matrix, bundle.full), ("final", matrix, model.columns), ("full_test", test, bundle.full), ("final_test", test, model.columns)):
        write_matrix(m, f"{folder}/features/{name}", columns)

    print_of = splits.fingerprint(rows).first()
    manifest = {
        "dataset_fingerprint": print_of["fingerprint"], "record_count": print_of["n"], "config_fingerprint": json_hash(settings), "config": settings, "seeds": seed,
        "split_sizes": {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}, "dependency_profile": profile,
        "dependency_versions": {p: importlib.metadata.version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}, "feature_schema_version": saved["version"], "schema_hash": saved["schema_hash"],
        "class_weight_decision": {"training_ratio": ratio[1], "applied": ratio[2]}, "selected_hyperparameters": model.params, "selected_run_id": choice.run_id, "model_version": MODEL_VERSION,
        "calibrated": calibrate, "test_evaluated": True, "timestamp_utc": datetime.datetime.now(datetime.UTC).isoformat(),
    }
    write_report(spark, folder, manifest, payload)
    files.write_bytes(spark, f"{folder}/{MARKER}", b"true")
    seal(spark, folder, manifest)
    return manifest


def seal(spark: SparkSession, folder: str, manifest: dict) -> dict:
    """Writes the hashes of all of the run's files, and the manifest with them."""
    own = {r["path"]: r["sha256"] for r in files.hashes(spark, folder, ("artifact_checksums.json", "run_manifest.json")).collect()}
    files.write_json(spark, f"{folder}/artifact_checksums.json", own)
    manifest["artifact_checksums"] = own
    files.write_json(spark, f"{folder}/run_manifest.json", manifest)
    return manifest


def write_report(spark: SparkSession, folder: str, manifest: dict, payload: dict, ablation: list[dict] | None = None) -> None:
    """A page for people."""
    test = payload["production"]["test"]
    rows = [
        "# Run report", "", f"- Dependency profile: `{manifest['dependency_profile']}`", f"- Records: **{manifest['record_count']}**", f"- Selected model: `{manifest['selected_run_id']}`",
        f"- Validation macro F1 at selection: **{payload['production']['validation']['macro_f1']:.6f}**",
        *(f"- Test {k}: **{test[k]:.6f}**" for k in ("macro_f1", "ordinal_mae", "balanced_accuracy")), "", "Importance of a feature is what the model relies on, not a cause.",
    ]
    if ablation:
        rows += ["", "## Ablation", "", "| Run | Macro F1 | Ordinal MAE | Balanced accuracy | Over A0 |", "|---|---:|---:|---:|---:|"]
        for r in ablation:
            v = r.get("validation")
            rows.append(f"| {r['run_id']} | {v['macro_f1']:.6f} | {v['ordinal_mae']:.6f} | {v['balanced_accuracy']:.6f} | {r['macro_f1_delta_vs_A0']:.6f} |" if v else f"| {r['run_id']} | {r['status']} | | | |")
    files.write_bytes(spark, f"{folder}/report.md", ("\n".join(rows) + "\n").encode("utf-8"))


def ablation(spark: SparkSession, folder: str, fit, plan: list | None = None) -> list[dict]:
    """Ablation over a saved run's training and validation features; its report and hashes are brought up to date."""
    manifest = files.read_json(spark, f"{folder}/run_manifest.json")
    files.verify_hashes(spark, folder, manifest["artifact_checksums"])
    rows = read_matrix(spark, f"{folder}/features/full")
    labels = json_records.read_selected(spark, f"{folder}/canonical", rows.select("question_id"))
    rows = cut(rows.join(labels.select("question_id", "y"), "question_id"), "ablation")
    columns = files.read_json(spark, f"{folder}/full_feature_schema.json")["columns"]
    found = learners.ablate(rows.where("split = 'train'"), rows.where("split = 'validation'"), columns, fit, plan=plan)
    files.write_json(spark, f"{folder}/ablation_results.json", found)
    write_report(spark, folder, manifest, files.read_json(spark, f"{folder}/metrics.json"), found)
    seal(spark, folder, {k: v for k, v in manifest.items() if k != "artifact_checksums"})
    return found
