"""Conditions of an optimum: met by fits, missed by other coefficients."""

from __future__ import annotations

import numpy as np
import pytest

from driftpanel.operators.baseline import fit_baseline, fit_candidates, fold_table, violations


@pytest.fixture(scope="module")
def landmarks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = (rng.random(120) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    return spark.createDataFrame([(str(i), a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "subject_id string, x array<double>, y int")


def test_fits_meet_the_conditions_and_report_it(landmarks):
    model = fit_baseline(landmarks, folds=3, grid_c=(0.05, 1.0, 50.0), grid_l1=(0.1, 0.9))
    assert model.converged and model.violation < 1e-7


def test_other_coefficients_do_not(landmarks):
    table = fold_table(landmarks, 3, 1)
    _, grid, betas = fit_candidates(table, 3, (1.0,), (0.5,))
    moved = [b + np.eye(4)[2] * 0.01 for b in betas]
    rows = violations(table, grid, moved).toPandas()
    assert len(rows) == 16 and set(rows["fold"]) == {-1, 0, 1, 2}
    assert (rows[rows["coefficient"] == 2]["violation"] > 1e-3).all()
    early = violations(table, grid, [np.zeros(4)] * 4).toPandas()
    assert early["violation"].max() > 1e-2
    table.unpersist()
