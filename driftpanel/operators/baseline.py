"""Elastic-net logistic regression on the landmark session: the static comparison model.

All (C, mix, fold) models of the grid are fitted together: each pass over the landmark table
sums every model's loss, gradient, and curvature, and the driver solves one small penalised
quadratic per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.hashing import order_key
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.ranks import rank_by_key
from driftpanel.operators.stats import average_precision

# Fixed grid: inverse regularisation strengths and l1 shares.
GRID_C = tuple(float(c) for c in np.logspace(-4, 4, 8))
GRID_L1 = (0.1, 0.5, 0.9)
#: A fit has settled when no coefficient has further to go.
CONVERGED = 1e-6


@dataclass
class _Fit:
    c: float
    l1: float
    fold: int  # held-out fold, -1 for none
    beta: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    done: bool = False


def _sums(table: DataFrame, fits: Sequence[_Fit]) -> dict[int, np.ndarray]:
    """Loss, gradient, curvature of the unpenalised log loss at each fit's trial point."""
    betas = np.stack([f.trial for f in fits])
    held = np.array([f.fold for f in fits])
    width = betas.shape[1]

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(betas), 1 + width + width * width))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(batch.num_rows, width - 1)
            x = np.column_stack([np.ones(len(x)), x])
            y = np.asarray(batch.column("y"), dtype=float)
            used = held[:, None] != np.asarray(batch.column("fold"))[None, :]
            margin = betas @ x.T
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
            total[:, 0] += (used * (np.logaddexp(0.0, margin) - y * margin)).sum(1)
            total[:, 1 : 1 + width] += (used * (p - y)) @ x
            total[:, 1 + width :] += np.einsum("mn,nd,ne->mde", used * p * (1 - p), x, x).reshape(len(betas), -1)
        yield pa.RecordBatch.from_arrays([pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(range(len(betas)), pa.int32())], names=["v", "fit"])

    parts = table.select("x", "y", "fold").mapInArrow(per_partition, "v array<double>, fit int")
    out: dict[int, dict[int, float]] = {}
    for row in parts.select("fit", F.posexplode("v")).groupBy("fit", "pos").agg(F.sum("col").alias("v")).collect():
        out.setdefault(row.fit, {})[row.pos] = row.v
    return {i: np.array([v[j] for j in range(len(v))]) for i, v in out.items()}


def _newton_step(fit: _Fit, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Minimise the penalised quadratic model by coordinate descent; the intercept is free."""
    width = len(gradient)
    beta = fit.beta.copy()
    h = fit.c * curvature + 1e-10 * np.eye(width)
    g = fit.c * gradient
    ridge, lasso = np.full(width, 1.0 - fit.l1), np.full(width, fit.l1)
    ridge[0] = lasso[0] = 0.0
    for _ in range(1000):
        largest = 0.0
        for j in range(width):
            slope = g[j] + h[j] @ (beta - fit.beta) - h[j, j] * beta[j]
            new = -np.sign(slope) * max(abs(slope) - lasso[j], 0.0) / (h[j, j] + ridge[j])
            largest = max(largest, abs(new - beta[j]))
            beta[j] = new
        if largest < 1e-11:
            break
    return beta


def _penalty(fit: _Fit, beta: np.ndarray) -> float:
    w = beta[1:]
    return (1.0 - fit.l1) / 2.0 * float(w @ w) + fit.l1 * float(np.abs(w).sum())


def fit_grid(table: DataFrame, grid: Sequence[tuple[float, float, int]], n_features: int, passes: int = 60) -> list[np.ndarray]:
    """Coefficients (intercept first) of each (C, l1 share, held-out fold)."""
    zero = np.zeros(n_features + 1)
    fits = [_Fit(c, l1, fold, zero.copy(), zero.copy()) for c, l1, fold in grid]
    for _ in range(passes):
        open_fits = [f for f in fits if not f.done]
        if not open_fits:
            break
        for i, row in _sums(table, open_fits).items():
            f = open_fits[i]
            loss = f.c * row[0] + _penalty(f, f.trial)
            if loss > f.loss + 1e-12 * max(1.0, abs(f.loss)):
                if np.abs(f.trial - f.beta).max() < 1e-9:
                    f.done = True
                f.trial = (f.trial + f.beta) / 2.0
                continue
            f.beta, f.loss = f.trial, loss
            n = len(zero)
            f.trial = _newton_step(f, row[1 : 1 + n], row[1 + n :].reshape(n, n))
            f.done = bool(np.abs(f.trial - f.beta).max() < 1e-8)
    return [f.beta for f in fits]


def violations(table: DataFrame, grid: Sequence[tuple[float, float, int]], betas: Sequence[np.ndarray]) -> DataFrame:
    """``c, l1, fold, coefficient, beta, violation``: how far each coefficient is from the conditions of an optimum.

    One more pass sums gradient and curvature at the coefficients. At an optimum the penalised gradient is 0 where
    a coefficient is not, and within the lasso's share where it is; what is beyond is divided by the curvature, so that it
    is about the step still to go.
    """
    fits = [_Fit(c, l1, fold, beta, beta) for (c, l1, fold), beta in zip(grid, betas, strict=True)]
    rows = []
    for i, row in sorted(_sums(table, fits).items()):
        f = fits[i]
        n = len(f.beta)
        ridge, lasso = np.full(n, 1.0 - f.l1), np.full(n, f.l1)
        ridge[0] = lasso[0] = 0.0
        slope = f.c * row[1 : 1 + n] + ridge * f.beta
        beyond = np.where(f.beta != 0, np.abs(slope + lasso * np.sign(f.beta)), np.maximum(np.abs(slope) - lasso, 0.0))
        far = beyond / np.maximum(1.0, f.c * np.diag(row[1 + n :].reshape(n, n)) + ridge)
        rows += [(f.c, f.l1, f.fold, j, float(f.beta[j]), float(far[j])) for j in range(n)]
    return table.sparkSession.createDataFrame(rows, "c double, l1 double, fold int, coefficient int, beta double, violation double")


def target_folds(landmarks: DataFrame, folds: int, seed: int) -> DataFrame:
    """Deal subjects into folds in hash order within each target class."""
    keyed = landmarks.withColumn("_key", order_key(seed, "baseline"))
    ranked = rank_by_key(keyed, ["y"], "_key", "subject_id", "_place")
    return ranked.withColumn("fold", ((F.col("_place") - 1) % folds).cast("int")).drop("_key", "_place")


def risk_column(beta: np.ndarray, x: str = "x"):
    margin = F.lit(float(beta[0]))
    for i, b in enumerate(beta[1:]):
        margin = margin + F.lit(float(b)) * F.get(x, F.lit(i))
    return 1.0 / (1.0 + F.exp(-margin))


def _fold_scores(table: DataFrame, grid, betas, n_candidates: int) -> DataFrame:
    """Mean held-out average precision of each candidate; fold-by-candidate coefficients are a small table."""
    rows = [(fold, i % n_candidates, b.tolist()) for i, ((_, _, fold), b) in enumerate(zip(grid, betas)) if fold >= 0]
    coefficients = table.sparkSession.createDataFrame(rows, "fold int, candidate int, beta array<double>")
    margin = F.aggregate(
        F.zip_with(F.slice("beta", F.lit(2), F.size("beta")), F.col("x"), lambda b, v: b * v), F.get("beta", F.lit(0)), lambda a, v: a + v
    )
    scored = table.join(F.broadcast(coefficients), "fold").select("fold", "candidate", "y", (1.0 / (1.0 + F.exp(-margin))).alias("score"))
    by_fold = average_precision(scored, "score", "y", ["fold", "candidate"])
    return by_fold.groupBy("candidate").agg(F.avg("average_precision").alias("score"))


@dataclass
class Baseline:
    c: float
    l1: float
    beta: np.ndarray
    n_train: int
    cv_scores: dict[tuple[float, float], float]
    violation: float = 0.0  # the largest of all fits of the grid

    @property
    def converged(self) -> bool:
        return self.violation <= CONVERGED


def fold_table(landmarks: DataFrame, folds: int, seed: int) -> DataFrame:
    """``subject_id, x, y, fold``, spread evenly and kept for the passes of a fit."""
    parallelism = landmarks.sparkSession.sparkContext.defaultParallelism
    table = target_folds(landmarks.select("subject_id", "x", "y"), folds, seed).repartition(parallelism, "subject_id")
    return cut_lineage(table).persist(StorageLevel.MEMORY_AND_DISK)


def fit_candidates(table: DataFrame, folds: int, grid_c: Sequence[float] = GRID_C, grid_l1: Sequence[float] = GRID_L1):
    """Candidates (C, l1 share), the grid (C, l1 share, held-out fold) of all fits, and their coefficients."""
    first = table.select(F.size("x")).first()
    if first is None:
        raise ValueError("no training subject has a landmark session and a known target")
    candidates = [(c, l1) for c in grid_c for l1 in grid_l1]
    grid = [(c, l1, fold) for fold in (-1, *range(folds)) for c, l1 in candidates]
    return candidates, grid, fit_grid(table, grid, first[0])


def fit_baseline(
    landmarks: DataFrame,
    seed: int = 42,
    folds: int = 5,
    grid_c: Sequence[float] = GRID_C,
    grid_l1: Sequence[float] = GRID_L1,
) -> Baseline:
    """Cross-validated fit over ``subject_id, x, y`` of the train subjects with a known target."""
    table = fold_table(landmarks, folds, seed)
    try:
        candidates, grid, betas = fit_candidates(table, folds, grid_c, grid_l1)
        worst = violations(table, grid, betas).agg(F.max("violation")).first()[0]
        scores = {r.candidate: r.score for r in _fold_scores(table, grid, betas, len(candidates)).collect()}
        best = max(range(len(candidates)), key=lambda i: (scores.get(i) if scores.get(i) is not None else -1.0, -i))
        n_train = table.count()
    finally:
        table.unpersist()
    return Baseline(*candidates[best], betas[best], n_train, {candidates[i]: s for i, s in scores.items()}, worst)


def predict_baseline(landmarks: DataFrame, baseline: Baseline) -> DataFrame:
    return landmarks.select("subject_id", F.col("y").alias("target"), risk_column(baseline.beta).alias("risk"))
