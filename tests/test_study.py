from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_data import SPEC, make_study
from driftpanel.operators.baseline import _penalty, _Fit, fit_baseline, fit_grid, predict_baseline
from driftpanel.operators.states import occupancy_text, transition_summary
from driftpanel.plans.analysis import run_analysis, run_full_analysis
from driftpanel.sources.tables import read_study
from driftpanel.sources.sinks import write_study
from test_statistics import brute_ap, brute_auc


def landmarks(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(x @ [1.5, -1.0, 0.0] - 0.5)))).astype(int)
    return x, y, spark.createDataFrame([(str(i), x[i].tolist(), int(y[i])) for i in range(n)], "subject_id string, x array<double>, y int")


def objective(x, y, beta, c, l1):
    margin = beta[0] + x @ beta[1:]
    return c * (np.logaddexp(0, margin) - y * margin).sum() + _penalty(_Fit(c, l1, -1, beta, beta), beta)


@pytest.mark.parametrize("c, l1", [(1e-3, 0.9), (0.05, 0.5), (1.0, 0.1), (1e4, 0.5)])
def test_elastic_net_reaches_the_minimum(spark, c, l1):
    x, y, df = landmarks(spark)
    beta = fit_grid(df.withColumn("fold", F.lit(0)), [(c, l1, -1)], 3)[0]
    best = objective(x, y, beta, c, l1)
    rng = np.random.default_rng(0)
    for size in (1e-1, 1e-2, 1e-3, 1e-4):
        for _ in range(50):
            assert objective(x, y, beta + rng.normal(0, size, 4), c, l1) >= best - 1e-9
    if c == 1e-3:
        assert (beta[1:] == 0).any()


def test_baseline_beats_chance_and_chooses_by_held_out_precision(spark):
    x, y, df = landmarks(spark)
    baseline = fit_baseline(df, grid_c=(0.01, 1.0), grid_l1=(0.1, 0.9))
    scored = predict_baseline(df, baseline).toPandas()
    assert brute_auc(scored["target"].to_numpy(), scored["risk"].to_numpy()) > 0.7
    assert baseline.n_train == 300 and max(baseline.cv_scores.values()) == baseline.cv_scores[(baseline.c, baseline.l1)]


def test_baseline_survives_separable_classes(spark):
    rows = [(str(i), [float(i - 20)], int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id string, x array<double>, y int")
    scored = predict_baseline(df, fit_baseline(df, grid_c=(1.0, 1e4), grid_l1=(0.5,))).toPandas()
    assert brute_ap(scored["target"].to_numpy(), scored["risk"].to_numpy()) == pytest.approx(1.0)


def test_transition_summary_keeps_empty_arms(spark):
    scored = spark.createDataFrame(
        [("a", "low", 4, 0), ("a", "low", 5, 1), ("a", "low", 6, 0), ("b", "low", 4, 2), ("c", "high", 4, 1), ("c", "high", 5, 1)],
        "subject_id string, arm string, t int, state int",
    )
    rows = {r.arm: r for r in transition_summary(scored, SPEC).collect()}
    assert rows["low"].n_transitions == 2 and rows["low"].worsening_fraction == 0.5 and rows["low"].recovery_fraction == 0.5
    assert rows["high"].stable_fraction == 1.0
    assert rows["control"].n_transitions == 0 and rows["control"].stable_fraction is None


def test_occupancy_text(spark):
    table = spark.createDataFrame([("x", 6, 0.125), ("a", 6, 0.6), ("a", 5, 0.9)], "arm string, t int, fraction_state_0 double")
    assert occupancy_text(table, 0, 6).first().occupancy == "a 60%, x 12%"


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("results"))
    tables = make_study(spark, n_per_arm=12, seed=51)
    options = dict(seed=51, candidates=(2, 3), restarts=1, cv_folds=2, n_iter=6, bootstrap_iterations=50, rho_iterations=60, permutations=60, grid_c=(0.1, 10.0), grid_l1=(0.5,))
    return run_analysis(*tables, SPEC, output=out, **options), out


def test_analysis_holds_its_identities(analysis):
    result, _ = analysis
    m = {(r.section, r.scope, r.metric): r.value for r in result.metrics.collect()}
    assert m[("split", "train", "n_subjects")] + m[("split", "test", "n_subjects")] == 48
    assert 0 <= m[("forecast", "all", "roc_auc")] <= 1
    assert m[("forecast_auc_interval", "all", "ci_low")] <= m[("forecast_auc_interval", "all", "ci_high")]
    assert m[("order_test", "all", "rho")] > 0.8
    forecasts = result.tables["early_predictions"].toPandas()
    assert (forecasts["steps"] == SPEC.t_target - forecasts["last_t"]).all() and (forecasts["last_t"] <= SPEC.t_cutoff).all()
    assert forecasts["risk"].between(0, 1).all() and not np.allclose(forecasts["risk"], forecasts["current_risk"])
    scored = result.tables["scored_sessions"].toPandas()
    parts = scored[[c for c in scored if c.startswith("p_state_")]].to_numpy()
    assert np.allclose(parts.sum(1), 1) and np.allclose(parts @ np.arange(parts.shape[1]), scored["expected_state"])
    chosen = result.selection.table.toPandas().sort_values("bic").iloc[0]
    assert chosen["n_states"] == result.selection.n_states


def test_analysis_writes_every_table_and_a_metrics_document(spark, analysis):
    result, out = analysis
    for name, df in result.tables.items():
        assert spark.read.parquet(f"{out}/tables/{name}").count() == df.count()
    document = json.loads(spark.read.text(f"{out}/metrics").first().value)
    assert document["split"]["train"]["n_subjects"] + document["split"]["test"]["n_subjects"] == 48


def test_missing_columns_stop_the_analysis(spark):
    sessions, outcomes, behavior = make_study(spark)
    with pytest.raises(ValueError, match="f_var"):
        run_analysis(sessions.drop("f_var"), outcomes, behavior, SPEC)


def test_normalised_tables_survive_a_round_trip(spark, tmp_path):
    sessions, outcomes, behavior = make_study(spark)
    for fmt in ("parquet", "csv"):
        folder = str(tmp_path / fmt)
        write_study(sessions, outcomes, behavior, folder, SPEC, fmt)
        back = read_study(spark, folder, SPEC, fmt)
        assert [b.count() for b in back] == [sessions.count(), outcomes.count(), behavior.count()]
        a = sessions.orderBy("subject_id", "t").select("subject_id", "t", "started_at", "f_var", "qc_pass").collect()
        b = back[0].orderBy("subject_id", "t").select("subject_id", "t", "started_at", "f_var", "qc_pass").collect()
        assert a == b
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first().value)
        assert manifest["n_subjects"] == 24 and set(manifest["arms"]) == set(SPEC.arms)


def test_full_analysis_from_renamed_csv_files(spark, tmp_path):
    sessions, _, _ = make_study(spark, n_per_arm=10, seed=3)
    rng = np.random.default_rng(0)
    raw = {
        "sessions": sessions.withColumnRenamed("subject_id", "animal").withColumnRenamed("t", "day"),
        "outcomes": sessions.select(F.col("subject_id").alias("animal")).distinct().withColumn("became_positive", F.lit(0)),
    }
    log = [
        (r.subject_id, r.t, bool(r.arm in ("moderate", "high") and rng.uniform() < 0.6), int(rng.integers(0, 4)), "swim", 300.0, 5.0, 1.0, 2.0, 3.0, 4.0, 0.9, True)
        for r in sessions.collect()
    ]
    from test_normalize import EVENT_SCHEMA

    raw["event_log"] = spark.createDataFrame(log, EVENT_SCHEMA).withColumnRenamed("subject_id", "animal").withColumnRenamed("t", "day")
    for name, df in raw.items():
        df.write.option("header", True).csv(str(tmp_path / name))
    result = run_full_analysis(
        spark, *[str(tmp_path / n) for n in ("sessions", "outcomes", "event_log")], str(tmp_path / "data"), str(tmp_path / "out"), SPEC,
        fmt="csv", rename={"animal": "subject_id", "day": "t"}, candidates=(2,), restarts=1, cv_folds=2, n_iter=3,
        bootstrap_iterations=20, rho_iterations=20, permutations=20, grid_c=(1.0,), grid_l1=(0.5,),
    )
    assert result.selection.n_states == 2
    assert os.path.isdir(tmp_path / "out" / "tables" / "split_assignments")
