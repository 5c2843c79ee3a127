from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panel_data import SPEC, make_study
from driftpanel.operators import quality
from driftpanel.spec import FeatureSpec


def broken(spark, change):
    sessions, outcomes, behavior = make_study(spark)
    return quality.panel_violations(change(sessions), outcomes, behavior, SPEC)


def test_a_valid_study_breaks_no_rule(spark):
    quality.require_clean(quality.panel_violations(*make_study(spark), SPEC))


@pytest.mark.parametrize(
    "rule, change",
    [
        ("qc_flag_differs_from_rule", lambda s: s.withColumn("shift", F.when(F.col("subject_id") == "S0001", 60.0).otherwise(F.col("shift")))),
        ("period_outside_window", lambda s: s.withColumn("t", F.when(F.col("subject_id") == "S0001", F.col("t") + 3).otherwise(F.col("t")))),
        ("duplicate_session", lambda s: s.union(s.where("subject_id = 'S0001' and t = 4"))),
        ("feature_not_finite", lambda s: s.withColumn("f_var", F.when(F.col("t") == 5, F.lit(float("nan"))).otherwise(F.col("f_var")))),
        ("negative_feature", lambda s: s.withColumn("f_rate", -F.col("f_rate") - 1)),
        ("unknown_arm", lambda s: s.withColumn("arm", F.lit("other"))),
        ("wrong_baseline_period", lambda s: s.withColumn("baseline_t", F.lit(2))),
        ("session_without_outcome", lambda s: s.withColumn("subject_id", F.concat(F.lit("X"), F.col("subject_id")))),
    ],
)
def test_each_rule_raises(spark, rule, change):
    with pytest.raises(ValueError, match=rule):
        quality.require_clean(broken(spark, change))


def test_features_never_hold_labels(spark):
    assert quality.leaked_features(SPEC.features) == []
    leaky = FeatureSpec(columns=("f_var", "dose"), rising=("f_var",))
    assert quality.leaked_features(leaky) == ["dose"]
    missing = quality.missing_columns(*make_study(spark), replace(SPEC, features=leaky))
    with pytest.raises(ValueError):
        quality.require_columns(missing)


def test_target_rules(spark):
    _, outcomes, _ = make_study(spark)
    counts = {r.rule: r.n_bad for r in quality.target_violations(outcomes.withColumn("target", F.lit(None).cast("int"))).collect()}
    assert counts["no_resolved_target"] == 1 and counts["target_mostly_unresolved"] == 1 and counts["target_has_one_class"] == 1
