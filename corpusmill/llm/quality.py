"""Document quality by a regularised quadratic discriminant.

Each text becomes a short vector of transformed statistics. Per class a mean and a shrinkage
covariance are estimated; a score is the difference of the two Gaussian log densities
(Mahalanobis terms by cached Cholesky factors) plus the log prior odds, through a logistic.

The fit needs the two classes' counts, sums and cross products only: each task adds up its own
rows, so labels of any number are used whole and the driver gets a few hundred numbers.

The covariances are shrunk toward the variances of all labelled rows by a weight that falls smoothly with a class's rows
(``shrinkage_weight``), at every number of rows by the same rule: a class of one row has those variances alone.
Gaussian tails overstate how sure the statistics are; ``TEMPERATURE`` divides the log odds, which leaves their order and
the even odds where they are and keeps scores graded.

Null and empty texts have the statistics of an empty text and get a score. Rows whose label is
null or not 0 or 1 take no part in the fit, nor do labels without a document. A document with several label
rows counts once for each, as does a label of several rows of a document. If a class has no rows at all, every
score is the share of label 1, or 0.5 without any label. Scores are rounded to 9 digits, which hides the
order in which sums were added. Rows repeat as often as they come; a null doc_id is not held out and has no label.
Extra columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, free_name, named, vector_total

THRESHOLD = 0.7
#: Rows for each statistic that a class needs before its own covariance counts as much as the common variances.
SHRINKAGE = 0.1
#: Ids of labelled documents that go to every executor whole, 8 bytes each.
KNOWN = 1 << 21
#: Keeps scores graded where the Gaussian tails are far apart.
TEMPERATURE = 4.0
_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*+=<>@\\^_~{}[]"
_DIGITS = b"0123456789"
#: Added before the logarithm of a share, so that shares of zero stay finite.
_FLOOR = 0.01
WIDTH = 14


def statistics(data: bytes) -> list[float]:
    """Transformed statistics of one text (UTF-8)."""
    n = len(data)
    words = data.split()
    k = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda x, of: float(np.log(_FLOOR + x / max(of, 1)))
    letters = sum(map(len, words))
    return [
        float(np.log1p(n)),
        float(np.log1p(letters / max(k, 1))),
        share(n - len(data.translate(None, _UPPER)), n),
        share(n - len(data.translate(None, _SIGNS)), n),
        share(data.count(b"|"), k),
        share(data.count(b"!"), k),
        share(n - len(data.translate(None, _DIGITS)), n),
        share(data.count(b".") + data.count(b","), k),
        share(len(lines), k),
        share(sum(map(bytes.__eq__, words, words[1:])), k),
        share(k - len(set(words)), k),
        share(k - len(set(zip(words, words[1:], strict=False))), k),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(max(map(len, words), default=0))),
    ]


def statistics_column(text: str = "text") -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts):
        return texts.map(lambda t: statistics(t.encode("utf-8", "surrogatepass") if t else b""))

    return stats(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Discriminant:
    """Two Gaussians; ``score`` maps statistics to (0, 1)."""

    means: np.ndarray | None  # (2, d)
    inverse_cholesky: np.ndarray | None  # (2, d, d): inverses of the lower factors
    log_dets: np.ndarray | None
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.bias)
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse_cholesky[c].T
            density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_dets[c])
        odds = (density[1] - density[0] + self.bias) / TEMPERATURE
        return np.round(1 / (1 + np.exp(-np.clip(odds, -60, 60))), 9)


def shrinkage_weight(n: float, d: int, shrinkage: float = SHRINKAGE) -> float:
    """Of the common variances in a class's covariance, for ``n`` rows of ``d`` statistics; 1 for one row."""
    return float(min(1.0, (1 + shrinkage * d) / (n + shrinkage * d)))


def fit_from_moments(n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """``n`` (2,), ``s`` (2, d), ``ss`` (2, d, d): counts, sums and sums of cross products."""
    if n.min() < 1:
        return Discriminant(None, None, None, float(n[1] / n.sum()) if n.sum() else 0.5)
    d = s.shape[1]
    means = s / n[:, None]
    cov = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
    # variances of all labelled rows, with one row more of unit variance, which counts where there are few
    centre = s.sum(axis=0) / n.sum()
    whole = np.diag(ss.sum(axis=0)) / n.sum() - centre * centre
    spread = (np.maximum(whole, 0) * n.sum() + 1) / (n.sum() + 1)
    roots, dets = [], []
    for c in (0, 1):
        k = shrinkage_weight(n[c], d, shrinkage)
        m = (1 - k) * cov[c] + k * np.diag(spread)
        low = np.linalg.cholesky(m)
        roots.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(roots), np.array(dets), float(np.log(n[1] / n[0])))


def usable(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, y) of the label rows that may be learned from."""
    return labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~held_out("doc_id"))


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", shrinkage: float = SHRINKAGE) -> Discriminant:
    """``stats``: (doc_id, x). Learns from every label row whose document is not held out."""
    rows = stats.select(F.col(doc_id).alias("doc_id"), "x").join(usable(labels, doc_id, label), "doc_id").select("y", "x")
    d, size = WIDTH, 1 + WIDTH + WIDTH * WIDTH

    def part(b: pa.RecordBatch) -> np.ndarray:
        y = b.column(0).to_numpy(zero_copy_only=False)
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        parts = [(len(z), z.sum(axis=0), (z.T @ z).ravel()) for z in (x[y == c] for c in (0, 1))]
        return np.concatenate([np.concatenate(([n], s, ss)) for n, s, ss in parts])

    total = vector_total(rows, 2 * size, part).reshape(2, size)
    return fit_from_moments(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), shrinkage)


def score_statistics(model: Discriminant, x: str = "x") -> Column:
    @F.pandas_udf("double")
    def score(xs):
        import pandas as pd

        return pd.Series(model.score(np.stack(xs.to_list())) if len(xs) else [], dtype="float64")

    return score(F.col(x))


def score_text(model: Discriminant, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([statistics(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts]).reshape(-1, WIDTH)
        return pd.Series(model.score(x), dtype="float64")

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    stats = cut(docs.select("doc_id", statistics_column("text").alias("x")), "quality-stats")
    model = fit(stats, labels)
    scored = stats.select("doc_id", held_out("doc_id").alias("held_out"), score_statistics(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``. Texts are not moved: statistics for the fit are
    taken of labelled documents only where their ids fit into ``KNOWN``, else of all."""
    known = cut(usable(labels).select("doc_id").distinct(), "quality-known")
    rows = docs.select("doc_id", "text").where(~held_out("doc_id"))
    if known.count() <= KNOWN:  # beyond that, statistics of all are cheaper than moving texts
        rows = rows.join(F.broadcast(known), "doc_id", "left_semi")
    model = fit(cut(rows.select("doc_id", statistics_column("text").alias("x")), "quality-labelled"), labels)
    score = free_name(docs, "_score")
    return docs.withColumn(score, score_text(model)).where(F.col(f"`{score}`") >= threshold).select(*named(docs.columns))
