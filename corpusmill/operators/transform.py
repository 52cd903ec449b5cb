"""Column statistics and transforms fitted on training rows: imputing, one-hot, selection, scaling, components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.quantiles import medians
from corpusmill.registry import CATEGORIES, FEATURES, INDICATORS
from corpusmill.session import named, vector_total


def clean(c: str) -> Column:
    """As a double; NaN is null."""
    return F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))


def moments(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariances with 1/n) of columns without nulls: a pass for the means, one for the products."""
    k = len(columns)
    first = rows.agg(F.count("*").alias("n"), *(F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns))).first()
    n, mean = first["n"], np.array([first[f"m{i}"] or 0.0 for i in range(k)])

    def part(b) -> np.ndarray:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - mean
        return (x.T @ x).ravel()

    total = vector_total(rows.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns))), k * k, part)
    return n, mean, total.reshape(k, k) / max(n, 1)


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, median, variance): exact median, population variance; a row per column."""
    mid = medians(rows, columns)
    one = rows.agg(*(F.struct(F.lit(c).alias("name"), F.count(clean(c)).alias("n"), F.lit(mid[c]).cast("double").alias("median"), F.var_pop(clean(c)).alias("variance")).alias(c) for c in columns))
    return one.select(F.inline(F.array(*named(columns)))).select("name", "n", F.round("median", 6).alias("median"), F.round("variance", 4).alias("variance"))


def apply_medians(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    """Nulls and NaN of these columns become the given values."""
    return rows.select(*(F.coalesce(clean(c), F.lit(values[c])).alias(c) if c in values else F.col(f"`{c}`") for c in rows.columns))


def impute(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN become the training median; other values stay."""
    return apply_medians(rows, medians(train, columns))


def all_missing(train: DataFrame, columns: list[str]) -> list[str]:
    """Columns that have no value in any training row."""
    if not columns:
        return []
    n = train.agg(*(F.count(clean(c)).alias(c) for c in columns)).first()
    return [c for c in columns if not n[c]]


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns; null where one does not vary."""
    _, _, cov = moments(rows.dropna(subset=columns), columns)
    sd = np.sqrt(np.diag(cov))
    pairs = [(a, b, float(round(cov[i, j] / (sd[i] * sd[j]), 6)) if sd[i] > 0 and sd[j] > 0 else None) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return rows.sparkSession.createDataFrame(pairs, "a string, b string, r double")


def uncorrelated(rows: DataFrame, columns: list[str], most: float = 0.9) -> list[str]:
    """Columns that vary, without those above that correlation to an earlier kept one."""
    if not columns:
        return []
    _, mean, cov = moments(rows, columns)
    var = np.diag(cov)
    varying = [i for i in range(len(columns)) if var[i] > 1e-20 * max(1.0, mean[i] ** 2)]
    if not varying:
        raise ValueError("all_features_constant")
    kept: list[int] = []
    for i in varying:
        if all(abs(cov[i, j]) <= most * np.sqrt(var[i] * var[j]) for j in kept):
            kept.append(i)
    return [columns[i] for i in kept]


def one_hot(rows: DataFrame, column: str, values: list[str], name: str | None = None) -> DataFrame:
    """``name=value`` doubles, the column's own name by default; an unknown value is all zero."""
    return rows.select("*", *((F.coalesce(F.col(column) == v, F.lit(False))).cast("double").alias(f"{name or column}={v}") for v in values))


def not_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with a null, NaN or infinite value in one of these columns."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        bad |= x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(bad)


def check_finite(rows: DataFrame, columns: list[str], reason: str = "final_feature_matrix_contains_nan_or_inf") -> None:
    if not_finite(rows, columns).limit(1).count():
        raise ValueError(reason)


def assemble(rows: DataFrame, keys: list[str] = ("question_id",)) -> DataFrame:
    """Keys, all features and indicators in the schema's order; a missing column is null, indicators are 0, categories Other."""
    def column(c: str) -> Column:
        if c in CATEGORIES:
            return F.coalesce(F.col(c), F.lit("Other")).alias(c) if c in rows.columns else F.lit("Other").alias(c)
        if c in rows.columns:
            return F.col(c).cast("double").alias(c)
        return F.lit(0.0 if c in INDICATORS else None).cast("double").alias(c)

    return rows.select(*named(keys), *(column(c) for c in [*FEATURES, *INDICATORS]))


@dataclass
class Scaler:
    """Means and population deviations; a column that does not vary is only centred."""

    columns: list[str]
    means: list[float]
    deviations: list[float]

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: (F.col(f"`{c}`") - m) / d for c, m, d in zip(self.columns, self.means, self.deviations, strict=True)})


def fit_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    r = train.agg(*(F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns))).first()
    return Scaler(columns, [float(r[f"m{i}"]) for i in range(len(columns))], [float(r[f"s{i}"] or 0) or 1.0 for i in range(len(columns))])


@dataclass
class Components:
    """Principal components of centred vectors, by falling variance; of each the largest weight is positive."""

    mean: np.ndarray
    axes: np.ndarray  # (components, width)
    ratios: np.ndarray

    @property
    def explained(self) -> float:
        return float(self.ratios.sum())

    def __call__(self, rows: DataFrame, vector: str = "embedding", prefix: str = "sem_pca_") -> DataFrame:
        """``rows`` with a double column per component; a null vector gives nulls."""
        mean, axes, k = self.mean, self.axes, len(self.axes)

        @F.pandas_udf("array<double>")
        def project(vectors):
            import pandas as pd

            x = np.array([v if v is not None else mean for v in vectors], float).reshape(-1, len(mean))
            y = (x - mean) @ axes.T
            return pd.Series([row if v is not None else None for row, v in zip(y, vectors, strict=True)])

        done = rows.withColumn("_components", project(F.col(vector)))
        return done.select(*named(rows.columns), *(F.get("_components", F.lit(i)).alias(f"{prefix}{i:03d}") for i in range(k)))


def fit_components(train: DataFrame, vector: str, count: int) -> Components:
    """From the covariance of all training vectors; more components than rows or coordinates are an error."""
    rows = train.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    most = min(width["w"] or 0, width["n"])
    if count < 1:
        raise ValueError("pca_components_must_be_positive")
    if count > most:
        raise ValueError(f"pca_components_exceed_train_dimensions:{count}>{most}")
    k, n = width["w"], width["n"]
    matrix = lambda b: b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    mean = vector_total(rows, k, lambda b: matrix(b).sum(axis=0)) / n
    cov = vector_total(rows, k * k, lambda b: ((matrix(b) - mean).T @ (matrix(b) - mean)).ravel()).reshape(k, k) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:count]
    axes = vectors[:, order].T
    axes = axes * np.where(axes[np.arange(count), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Components(mean, axes, values[order] / max(values.sum(), 1e-300))
