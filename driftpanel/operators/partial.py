"""Rank correlation after removing covariates by least squares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.ranks import attach, average_ranks
from driftpanel.operators.absorption import absorb
from driftpanel.operators.stats import spearman

#: Indicator columns of the design in all; factors with more levels are absorbed.
DENSE_LEVELS = 200


def one_hot(column: str, levels: Sequence) -> list[Column]:
    """Indicators of all but the first level, in sorted order."""
    return [F.coalesce((F.col(column) == level).cast("double"), F.lit(0.0)) for level in sorted(levels)[1:]]


def _cross_products(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Sum over rows of the outer product of ``columns``; one small matrix per partition is summed."""
    width = len(columns)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=float).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = df.select(F.array(*columns).alias("x")).mapInArrow(per_partition, "v array<double>")
    sums = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v"))
    out = np.zeros(width * width)
    for row in sums.collect():
        out[row.pos] = row.v
    return out.reshape(width, width)


def _demean(df: DataFrame, factor: str, columns: Sequence[str]) -> DataFrame:
    """Subtract level means; a level may hold most rows, so the means come by the skew-safe lookup."""
    means = df.groupBy(factor).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = attach(df, means, factor, "_n", [f"_m_{c}" for c in columns])
    return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def residualise(df: DataFrame, targets: Sequence[str], numeric: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """Replace ``targets`` by their residuals on [1, numeric, factor indicators], minimum-norm least squares.

    The factor with the most levels is removed by level means. The others become indicator columns where
    they have up to ``DENSE_LEVELS`` levels in all, a number that is counted first; otherwise all factors that do not fit are
    absorbed together with the widest (``absorption``), and no level reaches the driver. The residuals are the same
    either way. A NULL level has no indicator: it counts as the first level. Rows with a
    NULL in ``targets`` or ``numeric`` are the caller's to leave out.
    """
    seen = df.agg(*[F.struct(F.count_distinct(f).alias("n"), F.min(f).alias("low")).alias(f) for f in factors]).first() if factors else {}
    factors = sorted((f for f in factors if seen[f].n > 0), key=lambda f: seen[f].n)
    df = df.withColumns({f: F.coalesce(F.col(f), F.lit(seen[f].low)) for f in factors})
    design = {f"_z{i}": F.col(c).cast("double") for i, c in enumerate(numeric)}
    room = DENSE_LEVELS
    while len(factors) > 1 and seen[factors[0]].n <= room:
        f = factors.pop(0)
        room -= seen[f].n
        levels = [r[0] for r in df.select(f).distinct().collect()]
        design.update({f"_d_{f}_{i}": c for i, c in enumerate(one_hot(f, levels))})
    table = df.withColumns({**design, **{t: F.col(t).cast("double") for t in targets}})
    names = list(design)
    spread = dict.fromkeys(names, 0.0)
    if names:
        before = table.agg(*[F.max(F.abs(c)).alias(c) for c in names]).first()
        spread = {c: before[c] or 0.0 for c in names}
    if len(factors) == 1:
        table = _demean(table, factors[0], [*names, *targets])
    elif factors:
        # centred columns of about unit size, so that the tolerance means the same for all
        sizes = table.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in [*names, *targets]]).first()
        scale = {c: (sizes[c].m or 0.0, sizes[c].s or 1.0) for c in [*names, *targets]}
        table = cut_lineage(table.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}))
        table = absorb(table, list(scale), factors)
        table = cut_lineage(table.withColumns({c: F.col(c) * s for c, (_, s) in scale.items()}))
    if names:
        # centre and scale, so that the normal equations stay well conditioned
        stats = table.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names]).first()
        # a column that is constant (within levels) has no spread beyond rounding and repeats the intercept
        least = 1e-10 if len(factors) < 2 else 1e-7
        names = [c for c in names if stats[c].s is not None and stats[c].s > least * spread[c]]
        table = table.withColumns({c: (F.col(c) - stats[c].m) / stats[c].s for c in names})
    columns = [F.lit(1.0), *[F.col(c) for c in names]]
    p = len(columns)
    products = _cross_products(table, [*columns, *[F.col(t) for t in targets]])
    weights = np.linalg.pinv(products[:p, :p], rcond=1e-10, hermitian=True) @ products[:p, p:]
    residuals = {}
    for j, t in enumerate(targets):
        fitted = F.lit(float(weights[0, j]))
        for i, c in enumerate(names, start=1):
            fitted = fitted + F.lit(float(weights[i, j])) * F.col(c)
        residuals[t] = F.col(t) - fitted
    return table.withColumns(residuals).drop(*design)


def partial_spearman(df: DataFrame, x: str, y: str, numeric: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """One row ``n, rho``: rank both sides, remove the covariates, correlate the ranks of the residuals.

    Rows with a NULL or NaN in ``x``, ``y`` or a numeric covariate are left out, so ``n`` counts the rows
    used; a NULL factor level counts as the factor's first level.
    """
    kept = [c for c in dict.fromkeys(["subject_id", x, y, *numeric, *factors]) if c in df.columns]
    complete = F.lit(True)
    for c in (x, y, *numeric):
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    known = cut_lineage(df.where(complete).select(*kept))
    half = cut_lineage(average_ranks(known, x, "_rx").drop(x))
    ranked = cut_lineage(average_ranks(half, y, "_ry").drop(y))
    residuals = cut_lineage(residualise(ranked, ["_rx", "_ry"], numeric, factors).select("_rx", "_ry"))
    result = spearman(residuals, "_rx", "_ry").first()
    return df.sparkSession.createDataFrame([(result.n, result.rho)], "n long, rho double")
