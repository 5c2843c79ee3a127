"""Data-quality rules as violation tables ``rule, n_bad``; simple rules share one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.columns import is_finite, qc_rule
from driftpanel.functions.joins import by_key
from driftpanel.spec import FeatureSpec, PanelSpec

REQUIRED_SESSIONS = ("subject_id", "arm", "baseline_t", "t", "shift", "noise", "qc_pass", "dose")
REQUIRED_OUTCOMES = ("subject_id", "arm", "survived", "dose", "target")
REQUIRED_BEHAVIOR = ("subject_id", "t", "mean_likelihood", "tracking_qc_pass")
NEVER_FEATURES = (
    "subject_id", "arm", "dose", "target", "qc_pass", "t", "baseline_t", "shift", "noise", "pressure", "survived",
)


def _long(counts: DataFrame) -> DataFrame:
    """One row of named counts to rows ``rule, n_bad``."""
    entries = [F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n_bad")) for c in counts.columns]
    return counts.select(F.inline(F.array(*entries)))


def missing_columns(sessions: DataFrame, outcomes: DataFrame, behavior: DataFrame, spec: PanelSpec) -> dict[str, list[str]]:
    """Schema check: required columns absent from each table, and leaked model inputs."""
    wanted = {
        "sessions": (sessions, (*REQUIRED_SESSIONS, *spec.features.columns)),
        "outcomes": (outcomes, REQUIRED_OUTCOMES),
        "behavior": (behavior, REQUIRED_BEHAVIOR),
    }
    found = {name: sorted(set(columns) - set(df.columns)) for name, (df, columns) in wanted.items()}
    found["leaked_features"] = leaked_features(spec.features)
    return found


def leaked_features(features: FeatureSpec) -> list[str]:
    return sorted(set(features.columns) & set(NEVER_FEATURES))


def session_rules(spec: PanelSpec) -> dict[str, Column]:
    """Row predicates that mark a bad session."""
    features = spec.features.columns

    def any_of(test) -> Column:
        out = F.lit(False)
        for c in features:
            out = out | F.coalesce(test(c), F.lit(False))
        return out

    return {
        "period_outside_window": ~F.coalesce(F.col("t").isin(list(spec.periods)), F.lit(False)),
        "wrong_baseline_period": ~F.col("baseline_t").eqNullSafe(F.lit(spec.baseline_t)),
        "unknown_arm": ~F.coalesce(F.col("arm").isin(list(spec.arms)), F.lit(False)),
        "feature_not_finite": any_of(lambda c: ~is_finite(c)),
        "negative_feature": any_of(lambda c: F.col(c) < 0),
        "negative_session_dose": F.coalesce(F.col("dose") < 0, F.lit(False)),
        "qc_flag_differs_from_rule": ~F.coalesce(qc_rule(spec), F.lit(False)).eqNullSafe(F.col("qc_pass")),
    }


def session_violations(sessions: DataFrame, spec: PanelSpec) -> DataFrame:
    return _long(sessions.agg(*[F.count_if(bad).alias(name) for name, bad in session_rules(spec).items()]))


def duplicate_sessions(sessions: DataFrame) -> DataFrame:
    """Rows beyond the first of each (subject, period)."""
    copies = sessions.groupBy("subject_id", "t").agg(F.count(F.lit(1)).alias("_n"))
    return _long(copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_session")))


def orphans(sessions: DataFrame, outcomes: DataFrame, behavior: DataFrame) -> DataFrame:
    """Subjects of either session table that have no outcome row."""
    known = outcomes.select("subject_id")

    def count(df: DataFrame, rule: str) -> DataFrame:
        lost = df.select("subject_id").distinct().join(by_key(known), "subject_id", "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")

    return count(sessions, "session_without_outcome").union(count(behavior, "behavior_without_outcome"))


def target_violations(outcomes: DataFrame) -> DataFrame:
    n, resolved = F.count(F.lit(1)), F.count("target")
    return _long(
        outcomes.agg(
            F.when(resolved == 0, 1).otherwise(0).alias("no_resolved_target"),
            F.when((n > 0) & (resolved < 0.5 * n), 1).otherwise(0).alias("target_mostly_unresolved"),
            F.when(F.count_distinct("target") < 2, 1).otherwise(0).alias("target_has_one_class"),
            F.count_if(F.col("dose") < 0).alias("negative_outcome_dose"),
        )
    )


def split_violations(assignments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A subject in both parts, a subject in neither, an empty part."""
    per_subject = assignments.groupBy("subject_id").agg(F.count_distinct("split").alias("_parts"))
    joined = outcomes.select("subject_id").distinct().join(by_key(per_subject), "subject_id", "left")
    cover = joined.agg(
        F.count_if(F.col("_parts") > 1).alias("subject_in_both_parts"),
        F.count_if(F.col("_parts").isNull()).alias("subject_without_part"),
    )
    parts = assignments.agg(
        F.when(F.count_if(F.col("split") == "train") == 0, 1).otherwise(0).alias("empty_train"),
        F.when(F.count_if(F.col("split") == "test") == 0, 1).otherwise(0).alias("empty_test"),
    )
    return _long(cover).union(_long(parts))


def forecast_violations(forecasts: DataFrame, spec: PanelSpec) -> DataFrame:
    return _long(
        forecasts.agg(
            F.count_if(F.col("last_t") > spec.t_cutoff).alias("used_period_after_cutoff"),
            F.count_if(F.col("steps") <= 0).alias("no_forecast_horizon"),
            F.when(F.count_distinct("target") < 2, 1).otherwise(0).alias("test_has_one_class"),
        )
    )


def repeated_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that would break a one-to-one join."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _long(counts.agg(F.count_if(F.col("_n") > 1).alias(rule)))


def panel_violations(sessions: DataFrame, outcomes: DataFrame, behavior: DataFrame, spec: PanelSpec) -> DataFrame:
    """All rules over the three normalised tables."""
    return (
        session_violations(sessions, spec)
        .union(duplicate_sessions(sessions))
        .union(target_violations(outcomes))
        .union(orphans(sessions, outcomes, behavior))
        .union(repeated_keys(outcomes, "subject_id", "repeated_outcome"))
    )


def require_clean(violations: DataFrame) -> None:
    """Raise when any rule is broken; a violation table has one row per rule."""
    bad = {r.rule: r.n_bad for r in violations.where("n_bad > 0").collect()}
    if bad:
        raise ValueError(f"data-quality rules are broken: {bad}")


def require_columns(missing: Mapping[str, list[str]]) -> None:
    if any(missing.values()):
        raise ValueError(f"missing or leaked columns: {dict(missing)}")
