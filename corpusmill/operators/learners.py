"""Learners, their selection, calibration, importance of columns, and ablation runs, on tables of named columns.

A run's rows have ``y`` (0, 1, 2) and the named columns; predictions add ``probability`` (three numbers) and ``p``, the class
of the largest one, the lowest among equals. Gradient-boosted trees here are one binary ensemble a class
under their own run ids: no multiclass booster is available, and they are not the same model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import metrics
from corpusmill.operators.transform import Components, Scaler, fit_components, fit_scaler
from corpusmill.registry import family_columns
from corpusmill.session import cut, free_name

CLASSES = (0, 1, 2)
SCORES = ("macro_f1", "ordinal_mae", "balanced_accuracy", "accuracy", "kappa")


def arg_max(probability: Column) -> Column:
    """The class of the largest probability, the lowest among equals."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


@dataclass
class Model:
    """``predict(rows)`` adds ``probability`` and ``p``; ``columns`` are what it reads."""

    run_id: str
    columns: list[str]
    classifiers: list
    scaler: Scaler | None = None
    calibrators: list | None = None
    params: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame) -> DataFrame:
        vector, raw, names = free_name(rows, "_vector"), free_name(rows, "_scores"), rows.columns
        # the model reads copies, so the caller's columns come back as they were
        inputs = [free_name(rows, f"_x{i}") for i in range(len(self.columns))]
        ready = rows.withColumns({k: F.col(f"`{c}`").cast("double") for k, c in zip(inputs, self.columns, strict=True)})
        if self.scaler:
            ready = Scaler(inputs, self.scaler.means, self.scaler.deviations)(ready)
        done = VectorAssembler(inputCols=inputs, outputCol=vector).transform(ready)
        scores = []
        for i, m in enumerate(self.classifiers):
            at = free_name(done, f"{raw}{i}")
            m = m.copy()
            m.setFeaturesCol(vector).setPredictionCol(f"{at}_p").setProbabilityCol(at).setRawPredictionCol(f"{at}_r")
            done = m.transform(done)
            scores.append(vector_to_array(at))
        if len(scores) == 1:  # one classifier of all classes; a class it never saw has probability 0
            p = F.array(*(F.coalesce(F.get(scores[0], F.lit(c)), F.lit(0.0)) for c in CLASSES))
        else:
            p = _shares([F.get(s, F.lit(1)) for s in scores])
        done = done.select(*[F.col(f"`{c}`") for c in names if c not in ("probability", "p")], p.alias("probability"))
        if self.calibrators:
            done = calibrated(done, self.calibrators)
        return done.withColumn("p", arg_max(F.col("probability")))

    def importances(self) -> dict[str, float]:
        """Share of the splits' gain by column, the mean over the classifiers; sizes of weights for a linear model."""
        total = [0.0] * len(self.columns)
        for m in self.classifiers:
            own = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficientMatrix.toArray()).sum(axis=0)
            total = [t + float(x) / len(self.classifiers) for t, x in zip(total, own, strict=True)]
        return dict(zip(self.columns, total, strict=True))


def _shares(values: list[Column]) -> Column:
    """Divided by their sum; equal where all are zero."""
    whole = sum(values[1:], values[0])
    return F.array(*(F.when(whole > 0, v / whole).otherwise(1.0 / len(values)) for v in values))


def weight_column(train: DataFrame, balanced_below: float = 1.5) -> tuple[Column, float, bool]:
    """(weight of a row by its ``y``, largest class by smallest, whether weights differ): N / (3 n) beyond that ratio."""
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}  # three rows
    if any(not n.get(c) for c in CLASSES):
        raise ValueError("all_three_classes_required_for_class_weight_policy")
    ratio = max(n.values()) / min(n.values())
    if ratio <= balanced_below:
        return F.lit(1.0), ratio, False
    total = sum(n.values())
    return F.coalesce(*(F.when(F.col("y") == c, total / (3.0 * n[c])) for c in CLASSES)), ratio, True


def _ready(train: DataFrame, columns: list[str], weight: Column) -> DataFrame:
    inputs = [f"_x{i}" for i in range(len(columns))]
    rows = train.select(F.col("y").cast("double").alias("label"), weight.cast("double").alias("weight"), *(F.col(f"`{c}`").cast("double").alias(k) for k, c in zip(inputs, columns, strict=True)))
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("label", "weight", "features")


def logistic(train: DataFrame, columns: list[str], weight: Column, seed: int = 42, c: float = 1.0, iterations: int = 2000) -> Model:
    """Multinomial logistic regression on scaled columns; the penalty of ``c`` is on the sum of losses."""
    scaler = fit_scaler(train, columns)
    rows = _ready(scaler(train), columns, weight)
    total = rows.agg(F.sum("weight")).first()[0]
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-6).fit(rows)
    return Model("baseline_logistic", columns, [fitted], scaler)


def forest(train: DataFrame, columns: list[str], weight: Column, seed: int = 42, trees: int = 500, depth: int = 30) -> Model:
    """Random forest; ``depth`` 30 is the deepest there is, two rows a leaf at least."""
    fitted = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed).fit(_ready(train, columns, weight))
    return Model("baseline_rf", columns, [fitted])


def boosted(train: DataFrame, columns: list[str], weight: Column, seed: int = 42, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, rounds: int = 40, validation: DataFrame | None = None) -> Model:
    """A binary boosted ensemble for each class. With ``validation`` rows a class's rounds end where they stop helping there."""
    rows = _ready(train, columns, weight).withColumn("held", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(_ready(validation, columns, weight).withColumn("held", F.lit(True)))
    rows = cut(rows, "boosted-rows")
    models = []
    for c in CLASSES:
        own = rows.withColumn("label", (F.col("label") == c).cast("double"))
        learner = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth, stepSize=rate, subsamplingRate=subsample, maxIter=rounds, seed=seed, featureSubsetStrategy="0.8")
        models.append((learner.setValidationIndicatorCol("held") if validation is not None else learner).fit(own))
    params = {"max_depth": depth, "learning_rate": rate, "subsample": subsample, "n_estimators": max(m.getNumTrees for m in models)}
    return Model(f"gbt_d{depth}_l{rate}_s{subsample}", columns, models, params=params)


def grid() -> list[dict]:
    """Depths, rates and subsamples that are tried, in this order."""
    return [{"depth": d, "rate": r, "subsample": s} for d in (4, 6, 8) for r in (0.03, 0.05, 0.1) for s in (0.8, 1.0)]


def evaluate(model: Model, rows: DataFrame) -> dict[str, float]:
    return metrics.summary(model.predict(rows).select(F.col("y").cast("int").alias("y"), "p")).first().asDict()


def selection_key(scores: dict, run_id: str) -> tuple:
    """Smallest is best: macro F1 down, ordinal error up, balanced accuracy down, run id."""
    return (-scores["macro_f1"], scores["ordinal_mae"], -scores["balanced_accuracy"], run_id)


Candidate = tuple[str, Callable[[DataFrame, Column], Model]]


def candidates(engineered: list[str], final: list[str], seed: int = 42, tried: list[dict] | None = None, trees: int = 500, rounds: int = 40) -> list[Candidate]:
    """Both baselines on the engineered columns, then boosted trees of each setting on the selected ones."""
    out: list[Candidate] = [
        ("baseline_logistic", lambda rows, w: logistic(rows, engineered, w, seed)),
        ("baseline_rf", lambda rows, w: forest(rows, engineered, w, seed, trees)),
    ]
    for g in grid() if tried is None else tried:
        out.append((f"gbt_d{g['depth']}_l{g['rate']}_s{g['subsample']}", lambda rows, w, g=g: boosted(rows, final, w, seed, rounds=rounds, **g)))
    return out


@dataclass
class Choice:
    run_id: str
    fit: Callable[[DataFrame, Column], Model]
    model: Model | None
    runs: list[dict]


def select(train: DataFrame, validation: DataFrame, tried: list[Candidate]) -> Choice:
    """Each candidate fitted on train and scored on validation; the best by ``selection_key``."""
    weight, _, _ = weight_column(train)
    runs, models = [], {}
    for run_id, fit in tried:
        models[run_id] = fit(train, weight)
        runs.append({"run_id": run_id, "train": evaluate(models[run_id], train), "validation": evaluate(models[run_id], validation)})
    best = min(runs, key=lambda r: selection_key(r["validation"], r["run_id"]))["run_id"]
    return Choice(best, dict(tried)[best], models[best], runs)


def select_by_folds(folds: list[tuple[DataFrame, DataFrame]], tried_of: Callable[[int], list[Candidate]]) -> Choice:
    """The candidate of the best mean scores over (train, validation) pairs; ``tried_of(i)`` has them for pair i, as columns
    are selected anew in each. Nothing is fitted on all rows yet."""
    sums: dict[str, list[dict]] = {}
    for i, (train, validation) in enumerate(folds):
        weight, _, _ = weight_column(train)
        for run_id, fit in tried_of(i):
            sums.setdefault(run_id, []).append(evaluate(fit(train, weight), validation))
    runs = [{"run_id": k, "validation": {s: sum(x[s] for x in v) / len(v) for s in SCORES}} for k, v in sums.items()]
    best = min(runs, key=lambda r: selection_key(r["validation"], r["run_id"]))["run_id"]
    return Choice(best, dict(tried_of(0))[best], None, runs)


def refit(choice: Choice, train: DataFrame, validation: DataFrame | None) -> Model:
    """The chosen candidate on train and validation, with the class weights of train."""
    weight, _, _ = weight_column(train)
    return choice.fit(train if validation is None else train.unionByName(validation), weight)


# --- calibration ------------------------------------------------------------------------------


def calibrated(rows: DataFrame, calibrators: list[tuple[list[float], list[float]]]) -> DataFrame:
    """``rows`` with ``probability`` mapped class by class through (bounds, values), linear between bounds, then as shares."""

    def value(x: Column, bounds: list[float], values: list[float]) -> Column:
        out = F.lit(values[-1])
        for (a, b), (u, v) in reversed(list(zip(zip(bounds, bounds[1:], strict=False), zip(values, values[1:], strict=False), strict=True))):
            out = F.when(x < b, F.lit(u) + (x - a) * (((v - u) / (b - a)) if b > a else 0.0)).otherwise(out)
        return F.when(x <= bounds[0], values[0]).otherwise(out)

    own = [value(F.get("probability", F.lit(c)), *calibrators[c]) for c in CLASSES]
    return rows.withColumn("probability", _shares(own))


def calibrate(model: Model, validation: DataFrame) -> Model:
    """The same model with an isotonic map a class, fitted on rows it was not fitted on; the model stays as it is."""
    n = {r["y"]: r["n"] for r in validation.groupBy("y").agg(F.count("*").alias("n")).collect()}  # three rows
    if len(n) < 2:
        raise ValueError("calibration_requires_at_least_two_classes")
    if min(n.values()) < 2:
        raise ValueError("calibration_requires_at_least_two_examples_per_class")
    scored = cut(model.predict(validation).select("y", "probability"), "calibration")
    maps = []
    for c in CLASSES:
        rows = scored.select((F.col("y") == c).cast("double").alias("label"), F.get("probability", F.lit(c)).alias("features"))
        fitted = IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)
        maps.append((fitted.boundaries.toArray().tolist(), fitted.predictions.toArray().tolist()))
    return Model(model.run_id, model.columns, model.classifiers, model.scaler, maps, model.params)


# --- what a model relies on ---------------------------------------------------------------------


def permutation_importance(model: Model, rows: DataFrame, key: str = "question_id", repeats: int = 10, seed: int = 42) -> DataFrame:
    """(column, mean, deviation): how much macro F1 falls when a column's values are dealt to other rows.

    A value is dealt by hash order of the key: its row number there is the place of the row that gets it. The rows are those
    of a validation part; they are numbered in ranges, not in one task.
    """
    rows = cut(rows, "permutation-rows")
    base = evaluate(model, rows)["macro_f1"]
    spark, out = rows.sparkSession, []
    for c in model.columns:
        drops = []
        for r in range(repeats):
            at, to = numbered(rows, F.xxhash64(F.lit(seed), F.lit(r), F.lit(c), F.col(key))), numbered(rows.select(key, F.col(f"`{c}`").alias("dealt")), F.xxhash64(F.lit(seed + 1), F.lit(r), F.lit(c), F.col(key)))
            mixed = at.drop(c).join(to.drop(key), "nth").withColumnRenamed("dealt", c)
            drops.append(base - evaluate(model, mixed)["macro_f1"])
        mean = sum(drops) / repeats
        out.append((c, mean, (sum((d - mean) ** 2 for d in drops) / repeats) ** 0.5))
    return spark.createDataFrame(out, "column string, mean double, deviation double")


def numbered(rows: DataFrame, order: Column, buckets: int = 256) -> DataFrame:
    """``rows`` with ``nth``, 1 for the smallest ``order`` (a long hash): counts by range of it, then numbers inside a range."""
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", 64 - (buckets.bit_length() - 1)))
    n = rows.groupBy("_bucket").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.orderBy("_bucket")) - F.col("n")).drop("n")  # a row per bucket
    inside = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", *[F.col(f"`{c}`") for c in rows.columns[:1]])))
    return inside.join(F.broadcast(before), "_bucket").withColumn("nth", F.col("_nth") + F.col("before")).drop("_order", "_bucket", "_nth", "before")


def shap_summary() -> dict:
    """No library for Shapley values is used here; reports say so."""
    return {"status": "skipped", "reason": "shap_unavailable_or_not_installed"}


# --- ablation -----------------------------------------------------------------------------------


LADDER = ("lexical", "readability", "syntax", "task", "mcq", "tfidf", "semantic_scalar", "programming", "semantic_embedding")


def ablation_plan(columns: list[str], sizes: tuple[int, ...] = (32, 48, 64)) -> list[tuple[str, list[str]]]:
    """(run id, families): A0 without any, A1 of the first two, one family more a step, A8b with other numbers of
    components, then each family that has columns by itself (the embedding always)."""
    steps = [("A0", [])] + [(f"A{i}", list(LADDER[: i + 1])) for i in range(1, len(LADDER))]
    whole = [(f"A8b-{k}", list(LADDER)) for k in sizes]
    alone = [(f"S_{f}", [f]) for f in LADDER if f == "semantic_embedding" or family_columns(columns, [f])]
    return steps + whole + alone


def ablate(train: DataFrame, validation: DataFrame, columns: list[str], fit: Callable[[DataFrame, list[str], Column], Model], embedding: str | None = None, plan: list[tuple[str, list[str]]] | None = None) -> list[dict]:
    """A result for each run, fitted with the same settings on train and scored on validation; a run without columns, or
    that needs an embedding that is not there, is ``unavailable``. Test rows are never given here."""
    weight, _, _ = weight_column(train)
    majority = metrics.majority(train).first()["y"]
    out: list[dict] = []
    for run_id, families in plan or ablation_plan(columns):
        if run_id == "A0":
            scores = metrics.summary(validation.select(F.col("y").cast("int").alias("y"), F.lit(majority).alias("p"))).first().asDict()
            out.append({"run_id": run_id, "families": families, "validation": scores})
            continue
        has_components = any(c.startswith("sem_pca_") for c in columns)
        if "semantic_embedding" in families and not has_components:
            out.append({"run_id": run_id, "families": families, "status": "unavailable", "reason": "semantic_embedding_not_available"})
            continue
        if run_id.startswith("A8b-"):
            if embedding is None:
                out.append({"run_id": run_id, "families": families, "status": "unavailable", "reason": "raw_embeddings_not_persisted"})
                continue
            model: Components = fit_components(train, embedding, int(run_id.split("-")[1]))
            kept = [c for c in columns if not c.startswith("sem_pca_")]
            swap = lambda rows: model(rows.drop(*[c for c in rows.columns if c.startswith("sem_pca_")]), embedding)  # noqa: B023, E731
            own = kept + [f"sem_pca_{i:03d}" for i in range(len(model.axes))]
            scores = evaluate(fit(swap(train), own, weight), swap(validation))
            out.append({"run_id": run_id, "families": families, "validation": scores, "pca_components": len(model.axes)})
            continue
        own = family_columns(columns, families)
        if not own:
            out.append({"run_id": run_id, "families": families, "status": "unavailable", "reason": "no_columns_after_family_filter"})
            continue
        out.append({"run_id": run_id, "families": families, "validation": evaluate(fit(train, own, weight), validation), "features": own})
    return with_deltas(out)


def with_deltas(results: list[dict]) -> list[dict]:
    """Gain in macro F1 over A0, and over the step before for A1 to A8."""
    first, before = next(r for r in results if r["run_id"] == "A0")["validation"]["macro_f1"], None
    ladder = {f"A{i}" for i in range(1, len(LADDER))}
    out = []
    for r in results:
        r = dict(r)
        if "validation" in r:
            f1 = r["validation"]["macro_f1"]
            r["macro_f1_delta_vs_A0"] = f1 - first
            if r["run_id"] in ladder:
                r["macro_f1_delta_vs_previous_cumulative"] = None if before is None else f1 - before
                before = f1
        out.append(r)
    return out
