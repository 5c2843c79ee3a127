"""Made panels for the tests: a dosed study with a planted trend, and sequences of a known hidden chain."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

from driftpanel.spec import PanelSpec

SPEC = PanelSpec(arms=("control", "low", "moderate", "high"))
SESSION_SCHEMA = (
    "subject_id string, arm string, batch int, clutch string, plate string, baseline_t int, t int, n_drops int, "
    "pressure double, dose double, noise double, shift double, started_at timestamp, qc_pass boolean, "
    "f_var double, f_peak double, f_rate double, f_pow4 double"
)
OUTCOME_SCHEMA = "subject_id string, arm string, batch int, survived boolean, dose double, target int"
BEHAVIOR_SCHEMA = (
    "subject_id string, t int, arm string, abnormality double, mean_speed double, rest_fraction double, whirl_rate double, "
    "mean_likelihood double, tracking_qc_pass boolean, stage_max int"
)
DOSE = {"control": 0.0, "low": 40.0, "moderate": 80.0, "high": 120.0}


def make_rows(n_per_arm: int = 6, seed: int = 7, periods_of=None):
    """Arms take turns over subjects; a feature is a gamma draw whose mean grows with dose and with time."""
    rng = np.random.default_rng(seed)
    sessions, outcomes, behavior = [], [], []
    for i in range(n_per_arm * len(SPEC.arms)):
        arm = SPEC.arms[i // n_per_arm]
        subject, dose, batch = f"S{i + 1:04d}", DOSE[arm], int(rng.integers(1, 4))
        clutch, plate = f"CL{rng.integers(4):02d}", f"P{rng.integers(2)}"
        frailty = rng.normal(0.0, 0.04)
        load = 0.0
        periods = (periods_of or {}).get(subject, (4, 5, 6))
        for t in periods:
            load = 0.2 + dose / 40.0 + 0.45 * (t - 4) + frailty
            f = [float(v) for v in rng.gamma(400.0, (load + np.array([0.0, 0.15, 0.3, 0.1])) / 400.0)]
            at = datetime(2024, 3, 10) + timedelta(days=t, minutes=int(rng.integers(9 * 60, 17 * 60)))
            drops = int(dose // 40)
            sessions.append((subject, arm, batch, clutch, plate, 3, t, drops, 1.1 * dose, dose, 0.05, 8.0 + i % 7, at, True, *f))
            behavior.append((subject, t, arm, load * float(rng.uniform(0.9, 1.1)), 1.5, 0.4, 0.2, 0.95, True, drops))
        ill = int(rng.random() < 1 / (1 + np.exp(2.0 * (2.0 - load))))
        outcomes.append((subject, arm, batch, max(periods) >= 6, dose, ill))
    return sessions, outcomes, behavior


def make_study(spark, n_per_arm: int = 6, seed: int = 7, periods_of=None):
    tables = make_rows(n_per_arm, seed, periods_of)
    schemas = (SESSION_SCHEMA, OUTCOME_SCHEMA, BEHAVIOR_SCHEMA)
    return tuple(spark.createDataFrame(rows, schema) for rows, schema in zip(tables, schemas, strict=True))


def planted_sequences(spark, n: int = 240, seed: int = 4, stay: float = 0.7):
    """Four states on a ring: a step stays, or goes to one of the two neighbours; lengths are one and a Poisson draw."""
    rng = np.random.default_rng(seed)
    k = 4
    ring = np.arange(k)
    centres = np.stack([3.0 * ring, 2.0 * (-1.0) ** ring, np.cos(np.pi * ring / 2)], axis=1)
    rows = []
    for i in range(n):
        path = [int(rng.integers(k))]
        for _ in range(1 + rng.poisson(1.5)):
            path.append(path[-1] if rng.random() < stay else int((path[-1] + rng.choice((-1, 1))) % k))
        rows.append((str(i), (centres[path] + rng.normal(0, 0.5, (len(path), 3))).tolist(), path))
    return spark.createDataFrame(rows, "subject_id string, xs array<array<double>>, truth array<int>")
