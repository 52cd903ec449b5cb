"""Splits of small corpora, learners, and whole runs."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import files, inference, trainer
from corpusmill.operators import learners, metrics, splits
from corpusmill.operators.splits import Group
from corpusmill.plans import steps
from corpusmill.plans.questions import questions

SF = "/root/testdata/sf0.001"
CLASSES = ("Easy", "Moderate", "Hard")


def corpus(spark, n, family=lambda i: i):
    return spark.createDataFrame([(f"q{i}", CLASSES[i % 3], family(i)) for i in range(n)], "question_id string, label string, family long")


def test_held_out_part_is_the_plain_walk():
    rng = np.random.RandomState(5)
    for seed in range(6):
        groups = [Group(i, tuple(int(x) for x in rng.multinomial(rng.randint(1, 6), [0.4, 0.3, 0.3]))) for i in range(40)]
        order = np.random.RandomState(seed).random_sample(40)
        aim, walk = round(0.15 * sum(g.size for g in groups)), sorted(range(40), key=lambda i: (order[i], i))
        want = []
        for c in range(3):
            first = next(i for i in walk if groups[i].counts[c])
            want += [] if first in want else [first]
        used = base = sum(groups[i].size for i in want)
        for i in sorted((i for i in range(40) if i not in want), key=lambda i: (abs(base + groups[i].size - aim), order[i], i)):
            if used >= aim or len(want) >= 35:
                break
            want.append(i)
            used += groups[i].size
        assert splits.hold_out(groups, seed=seed) == set(want)
    with pytest.raises(ValueError):
        splits.hold_out(groups[:7])


def test_small_split_and_folds(spark):
    split = splits.split_records(corpus(spark, 30))
    parts = {r["question_id"]: (r["split"], r["label"]) for r in split.records.collect()}
    assert len(parts) == 30 and {s for s, _ in parts.values()} == {"train", "test"}
    assert {label for s, label in parts.values() if s == "test"} == set(CLASSES)
    pool = split.records.where("split = 'train'").select("question_id", "label", F.col("family_id").alias("family"))
    rows = splits.fold_rows(pool, split.folds).collect()
    n = pool.count()
    by_fold = Counter((r["repeat"], r["fold"], r["split"]) for r in rows)
    assert len({(r["repeat"], r["fold"]) for r in rows}) == 15 and all(by_fold[a, b, "train"] + by_fold[a, b, "validation"] == n for a in range(3) for b in range(5))
    assert Counter((r["repeat"], r["question_id"]) for r in rows if r["split"] == "validation") == Counter({(a, q): 1 for a in range(3) for q, (s, _) in parts.items() if s == "train"})
    for a in range(3):
        for b in range(5):
            for s in ("train", "validation"):
                assert {r["label"] for r in rows if (r["repeat"], r["fold"], r["split"]) == (a, b, s)} == set(CLASSES)
    assert splits.cross_validation([Group(i, (1, 1, 1)) for i in range(5)], seed=1)
    with pytest.raises(ValueError):
        splits.cross_validation([Group(i, (1, 1, 0)) for i in range(9)])
    with pytest.raises(ValueError):
        splits.split_records(corpus(spark, 0))
    with pytest.raises(ValueError):
        splits.small_groups(corpus(spark, 30), most=30)


def test_dispatch_by_size(spark):
    split = splits.split_records(corpus(spark, 60), most_off=0.1, small=60)
    assert split.folds is None and Counter(r["split"] for r in split.records.collect()) == {"train": 42, "validation": 9, "test": 9}


def test_folds_keep_families(spark):
    split = splits.split_records(corpus(spark, 300, lambda i: i // 4))
    parts = {}
    for r in split.records.collect():
        parts.setdefault(r["family_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in parts.values())


def test_arg_max_and_answers(spark):
    rows = spark.createDataFrame([("a", [0.4, 0.4, 0.2]), ("b", [0.1, 0.2, 0.7])], "question_id string, probability array<double>")
    rows = rows.withColumn("p", learners.arg_max(F.col("probability")))
    got = {r["question_id"]: r for r in inference.answers(rows, {"calibrated": False}).collect()}
    assert got["a"]["predicted_label"] == "Easy" and got["b"]["predicted_label"] == "Hard" and got["b"]["model_confidence"] == 0.7
    assert got["a"]["probabilities"] == {"Easy": 0.4, "Moderate": 0.4, "Hard": 0.2} and got["a"]["calibrated"] is False


def test_learners_and_calibration(spark):
    models = steps.baseline_models(spark, SF)
    held = steps._learning_rows(spark, SF).where("question_id % 4 = 0")
    worst = metrics.summary(held.select("y", F.lit(1).alias("p"))).first()["macro_f1"]
    for m in models.values():
        done = m.predict(held)
        assert done.columns == [*held.columns, "probability", "p"] and learners.evaluate(m, held)["macro_f1"] > worst
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in done.collect())
    forest = models["baseline_rf"]
    before = [tuple(r["probability"]) for r in forest.predict(held).orderBy("question_id").collect()]
    own = learners.calibrate(forest, held)
    assert [tuple(r["probability"]) for r in forest.predict(held).orderBy("question_id").collect()] == before
    assert learners.evaluate(own, held)["accuracy"] >= learners.evaluate(forest, held)["accuracy"] - 0.1
    with pytest.raises(ValueError):
        learners.calibrate(forest, held.where("y = 1"))
    assert set(forest.importances()) == {"a", "b", "c"} and abs(sum(forest.importances().values()) - 1) < 1e-9
    drops = {r["column"]: r["mean"] for r in learners.permutation_importance(models["gbt"], held, repeats=2).collect()}
    assert drops["a"] > drops["b"] - 0.05
    done = {x["nth"] for x in learners.numbered(held, F.xxhash64("question_id")).collect()}
    assert done == set(range(1, held.count() + 1))


def test_selection_order():
    good = {"macro_f1": 0.5, "ordinal_mae": 0.2, "balanced_accuracy": 0.5}
    keys = [learners.selection_key(good | c, r) for c, r in (({}, "a"), ({}, "b"), ({"balanced_accuracy": 0.4}, "0"), ({"ordinal_mae": 0.3}, "0"), ({"macro_f1": 0.4}, "0"))]
    assert keys == sorted(keys)
    assert [len(learners.grid()), learners.grid()[0], learners.grid()[-1]] == [18, {"depth": 4, "rate": 0.03, "subsample": 0.8}, {"depth": 8, "rate": 0.1, "subsample": 1.0}]


def write_corpus(spark, path, n):
    rows = [r for r in questions(spark, SF).orderBy("k").collect()][:n]
    lines = [json.dumps({"question": f"{r['question']} number {r['k']} {'deep ' * (r['k'] % 3)}", "label": CLASSES[r["k"] % 3]}) for r in rows]
    lines += [lines[0], "", json.dumps({"question": rows[1]["question"] + " twice", "label": "easy"}), json.dumps({"question": rows[1]["question"] + "  TWICE", "label": "hard"})]
    path.write_text("\n".join(lines) + "\n")


def few(rows, columns, weight):
    return learners.forest(rows, columns, weight, trees=3, depth=4)


def test_whole_run(spark, tmp_path):
    write_corpus(spark, tmp_path / "c.jsonl", 150)
    folder = str(tmp_path / "run")
    override = {"corpus": {"min_records": 100}, "validation": {"min_class_count": 3}, "ingest": {"max_reject_ratio": 0.1}, "split": {"small_dataset_threshold": 100, "max_ratio_deviation": 0.3}, "dedup": {"near_threshold": 1.0, "minhash_permutations": 16, "lsh_bands": 4}}
    manifest = trainer.train(spark, str(tmp_path / "c.jsonl"), folder, override, tried=[], trees=5, interpret=False)
    assert manifest["record_count"] == 150 and manifest["dependency_profile"] == "P4" and manifest["selected_run_id"].startswith("baseline_")
    assert files.read_json(spark, f"{folder}/duplicate_summary.json") == {"groups": 151, "conflicts": 1}
    rejected = spark.read.json(f"{folder}/rejected_records").collect()
    assert {(r["line"], r["reason"]) for r in rejected} == {(None, "duplicate_label_conflict")} and len(rejected) == 2
    with pytest.raises(ValueError, match="test_already_evaluated"):
        trainer.train(spark, str(tmp_path / "c.jsonl"), folder, override)
    predictor = inference.Predictor(spark, folder)
    asked = spark.createDataFrame([(f"Explain number {i}? n <= 10^{i}",) for i in range(4)], "question string")
    many = {r["question_id"]: r for r in predictor.predict(asked).collect()}
    one = predictor.predict(asked.where("question like '%number 2%'")).first()
    assert len(many) == 4 and many[one["question_id"]] == one and set(one["probabilities"]) == set(CLASSES)
    found = {r["run_id"]: r for r in trainer.ablation(spark, folder, few, [("A0", []), ("A1", ["lexical"]), ("A8", ["semantic_embedding"]), ("S_syntax", ["syntax"])])}
    assert found["A1"]["macro_f1_delta_vs_A0"] == found["A1"]["validation"]["macro_f1"] - found["A0"]["validation"]["macro_f1"]
    assert found["A8"]["status"] == found["S_syntax"]["status"] == "unavailable"
    assert b"## Ablation" in files.read_bytes(spark, f"{folder}/report.md")
    inference.Predictor(spark, folder)
    files.write_bytes(spark, f"{folder}/report.md", b"changed")
    with pytest.raises(ValueError, match="checksum"):
        inference.Predictor(spark, folder)


def test_ablation_of_components(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"q{i}", i % 3, float(i), rng.normal(i % 3, 0.3, 6).tolist()) for i in range(90)], "question_id string, y int, F01 double, vector array<double>")
    rows = rows.withColumn("sem_pca_000", F.get("vector", F.lit(0)))
    parts = rows.where("question_id not like '%5'"), rows.where("question_id like '%5'")
    found = learners.ablate(*parts, ["F01", "sem_pca_000"], few, "vector", [("A0", []), ("A8b-4", list(learners.LADDER))])
    assert found[1]["pca_components"] == 4 and found[1]["macro_f1_delta_vs_A0"] > 0.3
