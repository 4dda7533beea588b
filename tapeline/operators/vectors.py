"""Whole vectors: moments, similarities to a model, and archetypes with the choice of their number.

Vectors are used in full, their length is taken from the data. Moments are summed inside every partition and then by
place, so what reaches the driver is one matrix, whatever the number of rows; distances are worked out in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Number, mean and covariance (population) of the vectors of a group."""

    n: int
    mean: np.ndarray
    covariance: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """Deviations; 1 where a dimension doesn't vary."""
        s = np.sqrt(np.maximum(np.diag(self.covariance), 0.0))
        return np.where(s > 0, s, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def moments(rows: DataFrame, vector: str, group: str | None = None) -> dict[str | None, Moments]:
    """Moments of all vectors, or of each group's. Rows with a null vector or group are left out; lengths must agree.

    The number of groups and the square of the length bound what is returned. Empty in, empty out.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            x, names = _matrix(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                own = np.column_stack((np.ones((names == name).sum()), x[names == name]))
                held[name] = held.get(name, 0) + own.T @ own
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * total.size, pa.string()), pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["g", "place", "total"])

    key = F.lit("") if group is None else F.col(group).cast("string")
    picked = rows.where(F.col(vector).isNotNull() & key.isNotNull()).select(key.alias("g"), F.col(vector).cast("array<double>").alias("x"))
    summed = picked.mapInArrow(sums, "g string, place int, total double").groupBy("g", "place").agg(F.sum("total").alias("total"))
    found: dict[str, dict[int, float]] = {}
    for r in summed.collect():
        found.setdefault(r.g, {})[r.place] = r.total
    out = {}
    for name, total in found.items():
        d = math.isqrt(len(total))
        m = np.array([total[i] for i in range(d * d)]).reshape(d, d)
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        out[None if group is None else name] = Moments(int(n), mean, m[1:, 1:] / n - np.outer(mean, mean))
    return out


def squared_distances(rows: DataFrame, vector: str, centres: dict[str | None, np.ndarray], forms: dict[str | None, np.ndarray], group: str | None = None) -> DataFrame:
    """``rows`` with ``_d2``: (x - centre) form (x - centre) of each row's group; null where the vector or group is unknown."""
    order = rows.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([None] * len(batch) if group is None else [None if v is None else str(v) for v in batch.column(order.index(group)).to_pylist()], object)
            vectors, d2 = batch.column(order.index(vector)), np.full(len(batch), np.nan)
            present = np.array([v.is_valid for v in vectors], bool)
            for name, centre in centres.items():
                own = np.flatnonzero(present & (np.equal(names, name) if name is not None else np.ones(len(batch), bool)))
                if len(own):
                    x = _matrix(vectors.take(pa.array(own))) - centre
                    d2[own] = np.maximum(np.einsum("ij,ij->i", x @ forms[name], x), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d2, mask=np.isnan(d2))], [*order, "_d2"])

    return rows.mapInArrow(measure, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _d2 double")


def mahalanobis_similarity(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``sim``: 1 / (1 + distance) to the mean of all vectors, by the pseudo-inverse of their sample covariance."""
    whole = moments(rows, vector).get(None)
    if whole is None:
        return rows.withColumn("sim", F.lit(None).cast("double"))
    form = np.linalg.pinv(whole.covariance * whole.n / max(1, whole.n - 1), hermitian=True)
    return squared_distances(rows, vector, {None: whole.mean}, {None: form}).withColumn("sim", 1 / (1 + F.sqrt("_d2"))).drop("_d2")


def mixture_similarity(rows: DataFrame, vector: str, group: str) -> DataFrame:
    """``rows`` with ``sim``: the weight of the row's component times its full-covariance Gaussian kernel exp(-d2 / 2).

    A component is a group: its share of the rows, its mean, and its covariance with 1e-6 added to the variances.
    """
    parts = moments(rows, vector, group)
    total = sum(m.n for m in parts.values())
    forms = {k: np.linalg.inv(m.covariance + 1e-6 * np.eye(len(m.mean))) for k, m in parts.items()}
    weights = F.create_map(*(x for k, m in parts.items() for x in (F.lit(k), F.lit(m.n / total)))) if parts else None
    measured = squared_distances(rows, vector, {k: m.mean for k, m in parts.items()}, forms, group)
    weight = weights[F.col(group).cast("string")] if parts else F.lit(None).cast("double")
    return measured.withColumn("sim", weight * F.exp(-0.5 * F.col("_d2"))).drop("_d2")


def adjusted_rand(counts: dict[tuple[int, int], int]) -> float:
    """Agreement of two labellings, from how many rows have each pair of labels; 1 for the same partition."""
    pairs = lambda values: sum(v * (v - 1) / 2 for v in values)
    left, right = {}, {}
    for (a, b), n in counts.items():
        left[a], right[b] = left.get(a, 0) + n, right.get(b, 0) + n
    n = sum(left.values())
    both, one, two = pairs(counts.values()), pairs(left.values()), pairs(right.values())
    chance = one * two / max(1.0, n * (n - 1) / 2)
    top = (one + two) / 2
    return 1.0 if top == chance else (both - chance) / (top - chance)


@dataclass(frozen=True)
class Archetypes:
    """Settings of the search for archetypes."""

    counts: Sequence[int] = (2, 3)
    least_rows: int = 30
    least_in_cluster: int = 10
    seed: int = 0
    fits: int = 3
    least_stability: float = 0.75
    regularisation: float = 1e-6
    top: int = 5
    models: Sequence[str] = field(default=("gmm", "kmeans"))


def _fit(z: DataFrame, model: str, k: int, seed: int, regularisation: float):
    """(labelled rows, centres, bic): the mixture's bic is that of full covariances."""
    if model == "kmeans":
        fitted = KMeans(k=k, seed=seed, featuresCol="z", predictionCol="cluster", initSteps=10, maxIter=100).fit(z)
        return fitted.transform(z), [np.asarray(c) for c in fitted.clusterCenters()], None
    fitted = GaussianMixture(k=k, seed=seed, featuresCol="z", predictionCol="cluster", probabilityCol="weights").fit(z)
    centres = [np.asarray(g.mean.toArray()) for g in fitted.gaussians]
    d = len(centres[0])
    free = k - 1 + k * d + k * d * (d + 1) / 2
    summary = fitted.summary
    return fitted.transform(z).drop("weights"), centres, free * math.log(sum(summary.clusterSizes)) - 2 * summary.logLikelihood


def archetypes(rows: DataFrame, key: str, vector: str, settings: Archetypes | None = None) -> list[dict]:
    """The accepted archetypes and the rejected models, as a ledger of dictionaries in a fixed order.

    Vectors are z-scored by the population deviation. Each model and number of clusters is fitted, and refitted from
    further seeds; it is rejected if a cluster is empty or tiny, or if a refit's labels agree less than
    ``least_stability`` (adjusted Rand index). The silhouette is the one of squared distances, which takes one pass.
    Accepted clusters come with the dimensions that stand out most. ``key`` identifies rows; few rows, no fit.
    """
    s = settings or Archetypes()
    picked = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x"))
    whole = moments(picked, "x").get(None)
    if whole is None or whole.n < s.least_rows:
        return [{"model": "", "k": 0, "cluster": -1, "status": "insufficient_samples", "n": whole.n if whole else 0}]
    mean, scale = F.array(*map(F.lit, whole.mean.tolist())), F.array(*map(F.lit, whole.scale.tolist()))
    z = picked.select(key, array_to_vector(F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), scale, lambda a, b: a / b)).alias("z")).persist()
    ledger: list[dict] = []
    try:
        for model in sorted(s.models):
            for k in s.counts:
                ledger += _judge(z, key, model, k, whole.n, s)
    finally:
        z.unpersist()
    return ledger


def _judge(z: DataFrame, key: str, model: str, k: int, n: int, s: Archetypes) -> list[dict]:
    base = {"model": model, "k": k}
    if k >= n:
        return [base | {"cluster": -1, "status": "unsupported_count", "n": n}]
    labelled, centres, bic = _fit(z, model, k, s.seed, s.regularisation)
    sizes = {r.cluster: r.n for r in labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < k:
        return [base | {"cluster": -1, "status": "degenerate_labels", "n": len(sizes)}]
    tiny = [base | {"cluster": c, "status": "tiny_cluster", "n": sizes[c]} for c in range(k) if sizes[c] < s.least_in_cluster]
    if tiny:
        return tiny
    stability = 1.0
    for seed in range(s.seed + 1, s.seed + s.fits):
        other = _fit(z, model, k, seed, s.regularisation)[0].select(key, F.col("cluster").alias("other"))
        met = labelled.select(key, "cluster").join(other, key).groupBy("cluster", "other").agg(F.count(F.lit(1)).alias("n")).collect()
        stability = min(stability, adjusted_rand({(r.cluster, r.other): r.n for r in met}))
    if stability < s.least_stability:
        return [base | {"cluster": -1, "status": "unstable_model", "n": n, "stability": stability}]
    silhouette = ClusteringEvaluator(featuresCol="z", predictionCol="cluster").evaluate(labelled)
    found = []
    for c in range(k):
        best = sorted(range(len(centres[c])), key=lambda i: (-abs(float(centres[c][i])), i))[: s.top]
        found.append(base | {"cluster": c, "status": "accepted", "n": sizes[c], "stability": stability, "silhouette": silhouette, "bic": bic, "top": [int(i) for i in best], "centre": centres[c].tolist()})
    return found
