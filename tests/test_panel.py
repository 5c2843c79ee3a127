from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_data import SPEC, make_study
from driftpanel.functions.columns import propagate, state_label
from driftpanel.operators.hmm import HmmModel
from driftpanel.operators.sequences import build_sequences, contiguous_prefix, fit_scaler, landmark, log_rows, scale_rows
from driftpanel.operators.split import assign_folds, split_subjects
from driftpanel.operators.states import matrix_literal, severity_order, severity_table
from driftpanel.spec import FeatureSpec


def test_split_is_disjoint_complete_and_covers_every_arm(spark):
    _, outcomes, _ = make_study(spark, n_per_arm=8)
    split = split_subjects(outcomes).collect()
    assert len({r.subject_id for r in split}) == len(split) == 32
    for arm in SPEC.arms:
        assert sum(r.split == "test" for r in split if r.arm == arm) == round(0.3 * 8)
    again = {(r.subject_id, r.split) for r in split_subjects(outcomes.repartition(3)).collect()}
    assert again == {(r.subject_id, r.split) for r in split}
    with pytest.raises(ValueError):
        split_subjects(outcomes, 0.9)


def test_split_keeps_its_shares_when_one_arm_holds_almost_everyone(spark):
    rows = [(f"S{i:05d}", "high" if i % 50 else "low", None if i % 7 == 0 else i % 2) for i in range(6000)]
    outcomes = spark.createDataFrame(rows, "subject_id string, arm string, target int")
    counts = {(r.arm, r.split): r["count"] for r in split_subjects(outcomes).groupBy("arm", "split").count().collect()}
    assert counts[("high", "test")] == round(0.3 * 5880) and counts[("low", "test")] == round(0.3 * 120)


def test_folds_are_even_within_arms(spark):
    _, outcomes, _ = make_study(spark, n_per_arm=10)
    folds = assign_folds(split_subjects(outcomes), 3)
    sizes = [r["count"] for r in folds.groupBy("arm", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        assign_folds(split_subjects(outcomes), 1)


def test_prefix_ends_at_the_cutoff_and_at_gaps(spark):
    sessions, _, _ = make_study(spark, periods_of={"S0001": (4, 6), "S0002": (5, 6)})
    prefix = contiguous_prefix(sessions, SPEC)
    periods = {r.subject_id: sorted(r.ts) for r in prefix.groupBy("subject_id").agg(F.collect_list("t").alias("ts")).collect()}
    assert periods["S0001"] == [4] and "S0002" not in periods and periods["S0003"] == [4, 5, 6]
    early = contiguous_prefix(sessions, SPEC, cutoff=5)
    assert early.agg(F.max("t")).first()[0] == 5
    assert landmark(prefix, SPEC).where("subject_id = 'S0003'").first().t == 5


def test_log_transform_is_exact(spark):
    sessions, _, _ = make_study(spark)
    values = {"f_var": 3.0, "f_peak": 7.0, "f_rate": 1.5, "f_pow4": 12.0}
    row = log_rows(sessions.withColumns({c: F.lit(v) for c, v in values.items()}), SPEC).first()
    assert [row[c] for c in values] == pytest.approx(np.log1p(list(values.values())))


def test_scaler_is_median_and_interquartile_range_of_the_given_rows(spark):
    sessions, _, _ = make_study(spark)
    prefix = contiguous_prefix(sessions, SPEC)
    row = fit_scaler(prefix, SPEC).first()
    x = np.log1p(np.array([[r[c] for c in SPEC.features.columns] for r in prefix.collect()]))
    q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
    assert row.center == pytest.approx(q2) and row.scale == pytest.approx(q3 - q1)
    flat = fit_scaler(prefix.withColumn("f_var", F.lit(2.0)), SPEC).first()
    assert flat.scale[0] == 1.0
    with pytest.raises(Exception, match="no training observations"):
        fit_scaler(prefix.where("false"), SPEC).collect()


def test_sequences_are_in_period_order(spark):
    sessions, _, _ = make_study(spark)
    prefix = contiguous_prefix(sessions, SPEC)
    built = build_sequences(scale_rows(prefix, fit_scaler(prefix, SPEC), SPEC), SPEC)
    assert built.where(F.col("ts") != F.array_sort("ts")).count() == 0
    assert built.where(F.size("xs") != F.size("ts")).count() == 0


def test_severity_order_and_its_table(spark):
    means = np.array([[1.0] * 4, [3.0] * 4, [0.1] * 4])
    model = HmmModel(np.ones(3) / 3, np.ones((3, 3)) / 3, means, np.ones((3, 4)))
    assert severity_order(model, SPEC.features).tolist() == [2, 0, 1]
    rows = [(k, f, float(means[k, d])) for k in range(3) for d, f in enumerate(SPEC.features.columns)]
    table = severity_table(spark.createDataFrame(rows, "state int, feature string, mean double"), SPEC.features)
    assert {r.state: r.severity for r in table.collect()} == {0: 1, 1: 2, 2: 0}
    falling = FeatureSpec(rising=("f_var",), falling=("f_pow4",))
    means[:, 3] = [9.0, 0.0, 5.0]
    assert severity_order(model, falling).tolist() == [0, 2, 1]
    with pytest.raises(ValueError):
        FeatureSpec(rising=("unknown",))


def test_propagation_is_repeated_multiplication(spark):
    a = np.array([[0.8, 0.2], [0.1, 0.9]])
    df = spark.createDataFrame([(0,), (1,), (2,), (-1,)], "steps int")
    p = F.array(F.lit(0.7), F.lit(0.3))
    out = df.withColumn("q", propagate(p, matrix_literal(a), F.col("steps"), 2))
    for row in out.where("steps >= 0").collect():
        assert row.q == pytest.approx(np.array([0.7, 0.3]) @ np.linalg.matrix_power(a, row.steps))
    with pytest.raises(Exception, match="cannot be negative"):
        out.collect()


def test_state_labels_need_a_known_name(spark):
    df = spark.createDataFrame([(2,)], "s int")
    assert df.select(state_label(F.col("s"), 3)).first()[0] == "2 (Hyperexcitable / ictal-like)"
    with pytest.raises(ValueError):
        state_label(F.col("s"), 5)
    with pytest.raises(Exception, match="without a name"):
        df.select(state_label(F.col("s"), 2)).collect()


def test_forecast_does_not_see_periods_after_the_cutoff(spark):
    from driftpanel.operators.states import decode, forecast, model_sequences
    from driftpanel.plans.context import FIXED_MODEL

    sessions, outcomes, _ = make_study(spark, periods_of={"S0001": (4,), "S0002": (4, 5), "S0003": (4, 6)})
    scaler = fit_scaler(contiguous_prefix(sessions, SPEC), SPEC)
    order = severity_order(FIXED_MODEL, SPEC.features)

    def risks(cutoff):
        sequences = model_sequences(sessions, scaler, SPEC, cutoff)
        table = forecast(decode(sequences, FIXED_MODEL, order), outcomes, FIXED_MODEL, order, SPEC)
        return {r.subject_id: (r.last_t, r.steps, round(r.risk, 12)) for r in table.collect()}

    whole, early = risks(None), risks(SPEC.t_cutoff)
    assert whole == early
    assert whole["S0001"][:2] == (4, 2) and whole["S0002"][:2] == (5, 1) and whole["S0003"][:2] == (4, 2)
