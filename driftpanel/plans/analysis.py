"""The whole study as one plan: from raw or normalised tables to result tables and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.sampling import stage_seed
from driftpanel.functions.pvalues import p_value
from driftpanel.operators import behavior as behave
from driftpanel.operators import ordering, quality, stats
from driftpanel.operators.baseline import GRID_C, GRID_L1, fit_baseline, predict_baseline
from driftpanel.operators.normalize import normalize_behavior, normalize_outcomes, normalize_sessions
from driftpanel.operators.selection import Selection, select_state_count
from driftpanel.operators.sequences import contiguous_prefix, landmark, qc_sessions, restrict, scale_rows
from driftpanel.operators.split import assign_folds, split_subjects
from driftpanel.operators.states import (
    by_arm_and_period,
    decode,
    forecast,
    model_sequences,
    occupancy,
    parameter_tables,
    score_sessions,
    severity_order,
    state_columns,
    state_index,
    transition_summary,
    transition_wide,
)
from driftpanel.sources.sinks import write_results, write_study
from driftpanel.sources.tables import read_raw_study, read_study
from driftpanel.spec import PanelSpec


@dataclass
class Analysis:
    """Result tables by name, metrics as rows ``section, scope, metric, value``, and the fitted selection."""

    tables: dict[str, DataFrame]
    metrics: DataFrame
    selection: Selection


def normalize_study(sessions: DataFrame, outcomes: DataFrame, event_log: DataFrame, spec: PanelSpec):
    """Raw tables to normalised sessions, outcomes, and behaviour; sessions are written once for both."""
    clean = cut_lineage(normalize_sessions(sessions, spec))
    return clean, normalize_outcomes(clean, outcomes, event_log, spec), normalize_behavior(clean, event_log)


def dataset_summary(sessions: DataFrame, outcomes: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row of cohort and quality-control counts."""
    prefix = contiguous_prefix(restrict(qc_sessions(sessions), outcomes), spec).agg(
        F.count(F.lit(1)).alias("n_contiguous_sessions"),
        F.count_if(F.col("t") == spec.t0).alias("n_subjects_with_baseline"),
    )
    counts = sessions.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.count_if("qc_pass").alias("n_qc_pass"),
        F.try_divide(F.count_if("qc_pass"), F.count(F.lit(1))).alias("qc_pass_rate"),
    )
    subjects = outcomes.agg(F.count(F.lit(1)).alias("n_subjects"))
    return subjects.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(prefix))


def survival_by_arm(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("arm").agg(F.avg(F.col("survived").cast("double")).alias("survival_rate"))


def landmark_vectors(sessions: DataFrame, outcomes: DataFrame, scaler: DataFrame, spec: PanelSpec) -> DataFrame:
    """``subject_id, x, y``: scaled features of the last session up to the cutoff, and the known target."""
    rows = scale_rows(landmark(contiguous_prefix(sessions, spec, spec.t_cutoff), spec), scaler, spec)
    known = outcomes.where(F.col("target").isNotNull()).select("subject_id", F.col("target").alias("y"))
    vector = F.array(*[F.col(c) for c in spec.features.columns])
    return rows.select("subject_id", vector.alias("x")).join(by_key(known), "subject_id")


def as_metrics(df: DataFrame, section: str, scope: str | None = None) -> DataFrame:
    """A summary of a few rows to ``section, scope, metric, value``; ``scope`` names a label column."""
    values = [c for c in df.columns if c != scope]
    entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values]
    label = F.col(scope).cast("string") if scope else F.lit("all")
    return df.select(F.lit(section).alias("section"), label.alias("scope"), F.inline(F.array(*entries)))


def score_metrics(predictions: DataFrame, risk: str = "risk") -> DataFrame:
    """AUC, average precision, Brier, and confusion of one scored table, as one row."""
    parts = [
        stats.roc_auc(predictions, risk, "target"),
        stats.average_precision(predictions, risk, "target"),
        stats.brier(predictions, risk, "target"),
        stats.confusion(predictions, risk, "target"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))
    return row


def run_analysis(
    sessions: DataFrame,
    outcomes: DataFrame,
    behavior: DataFrame,
    spec: PanelSpec,
    output: str | None = None,
    seed: int = 42,
    test_fraction: float = 0.30,
    candidates: Sequence[int] = (2, 3),
    restarts: int = 3,
    cv_folds: int = 3,
    bootstrap_iterations: int = 1_000,
    rho_iterations: int = ordering.BOOTSTRAP_ITERATIONS,
    permutations: int = ordering.PERMUTATION_ITERATIONS,
    n_iter: int = 160,
    grid_c: Sequence[float] = GRID_C,
    grid_l1: Sequence[float] = GRID_L1,
    fmt: str = "parquet",
) -> Analysis:
    """Split, fit, choose, decode, forecast, evaluate, and control; optionally write everything."""
    quality.require_columns(quality.missing_columns(sessions, outcomes, behavior, spec))
    quality.require_clean(quality.panel_violations(sessions, outcomes, behavior, spec))

    usable = cut_lineage(qc_sessions(sessions))
    outcomes = cut_lineage(outcomes)
    assignments = cut_lineage(split_subjects(outcomes, test_fraction, seed))
    quality.require_clean(quality.split_violations(assignments, outcomes))
    train = assignments.where(F.col("split") == "train")
    test = assignments.where(F.col("split") == "test")

    chosen = select_state_count(
        usable, assign_folds(assignments, cv_folds, seed), spec, candidates, seed, restarts, cv_folds, n_iter, min(n_iter, 130)
    )
    model, k = chosen.model, chosen.n_states
    order = severity_order(model, spec.features)

    decoded = cut_lineage(decode(model_sequences(restrict(usable, outcomes), chosen.scaler, spec), model, order))
    scored = cut_lineage(score_sessions(restrict(decoded, test)))
    forecasts = cut_lineage(forecast(restrict(decoded, test), outcomes, model, order, spec))
    quality.require_clean(quality.forecast_violations(forecasts, spec))

    index = cut_lineage(state_index(decoded))
    occupied = occupancy(scored, k)
    transitions = transition_summary(scored, spec)

    quality.require_clean(quality.repeated_keys(behave.target_behavior(behavior, spec), "subject_id", "repeated_behavior"))
    merged = cut_lineage(behave.merge_behavior(forecasts, behavior, spec))

    vectors = cut_lineage(landmark_vectors(usable, outcomes, chosen.scaler, spec))
    baseline = fit_baseline(restrict(vectors, train), seed, grid_c=grid_c, grid_l1=grid_l1)
    baseline_predictions = cut_lineage(predict_baseline(restrict(vectors, test), baseline))

    primary = ordering.primary_test(index, outcomes, spec, seed, rho_iterations, permutations)
    held_out = ordering.primary_test(restrict(index, test), outcomes, spec, stage_seed(seed, "held out"), rho_iterations, permutations)
    adjusted = ordering.covariate_adjusted(index, outcomes, usable, spec)
    refit = ordering.control_only_refit(
        usable, outcomes, spec, k, stage_seed(seed, "control refit"), restarts, n_iter, rho_iterations, permutations
    )
    left_out = ordering.leave_one_arm_out(index, outcomes, spec)
    draws = cut_lineage(ordering.forecast_draws(forecasts, stage_seed(seed, "forecast"), bootstrap_iterations))

    forecast_metrics, baseline_metrics = score_metrics(forecasts), score_metrics(baseline_predictions)
    winners = behave.compare_models(as_metrics(forecast_metrics, "f"), as_metrics(baseline_metrics, "b"))
    headline = winners.where(F.col("metric").isin("roc_auc", "average_precision", "brier_score"))
    parameters = parameter_tables(usable, model, order, spec)
    spark = sessions.sparkSession
    baseline_choice = spark.createDataFrame([(baseline.c, baseline.l1, baseline.n_train)], "chosen_c double, chosen_l1 double, n_train long")

    def rho(df: DataFrame) -> DataFrame:
        return df.withColumn("p", p_value("rho", "n"))

    metrics = (
        as_metrics(assignments.groupBy("split").agg(F.count(F.lit(1)).alias("n_subjects")), "split", "split")
        .union(as_metrics(dataset_summary(sessions, outcomes, spec), "dataset"))
        .union(as_metrics(survival_by_arm(outcomes), "survival", "arm"))
        .union(as_metrics(chosen.table, "model_selection", "n_states"))
        .union(as_metrics(spark.createDataFrame([(k,)], "selected_states int"), "model_selection"))
        .union(as_metrics(forecast_metrics, "forecast"))
        .union(as_metrics(stats.calibration(forecasts, "risk", "target"), "calibration"))
        .union(as_metrics(stats.percentile_interval(draws, "roc_auc"), "forecast_auc_interval"))
        .union(as_metrics(stats.percentile_interval(draws, "average_precision"), "forecast_ap_interval"))
        .union(as_metrics(rho(behave.dose_risk_rho(forecasts)), "dose_vs_risk"))
        .union(as_metrics(transitions, "transitions", "arm"))
        .union(as_metrics(rho(behave.behavior_rho(merged)), "behavior"))
        .union(as_metrics(rho(behave.adjusted_behavior_rho(merged)), "behavior_adjusted"))
        .union(as_metrics(baseline_metrics, "baseline"))
        .union(as_metrics(baseline_choice, "baseline"))
        .union(as_metrics(headline.withColumn("forecast_ahead", F.col("ahead") == "forecast").drop("ahead"), "comparison", "metric"))
        .union(as_metrics(primary, "order_test"))
        .union(as_metrics(held_out, "order_test_held_out"))
        .union(as_metrics(rho(adjusted), "order_test_adjusted"))
        .union(as_metrics(refit, "control_only_refit"))
        .union(as_metrics(rho(left_out), "leave_one_arm_out", "held_out"))
        .union(as_metrics(parameters["start"], "start", "state"))
    )
    tables = {
        "split_assignments": assignments,
        "scored_sessions": scored.select(
            "subject_id", "arm", "t", "pressure", "dose", F.col("state").alias("predicted_state"), "expected_state", *state_columns(k)
        ),
        "early_predictions": forecasts,
        "baseline_predictions": baseline_predictions,
        "state_index": index.join(by_key(outcomes.select("subject_id", "arm")), "subject_id", "left"),
        "state_occupancy": by_arm_and_period(occupied, spec),
        "group_transitions": transitions,
        "transition_matrix": transition_wide(parameters["transition"], k),
        "emission_means": parameters["emission"],
        "negative_controls": ordering.negative_controls(primary, refit, left_out),
        "roc_curve": stats.roc_points(forecasts, "risk", "target"),
    }
    if output:
        write_results(tables, metrics, output, fmt)
    return Analysis(tables, metrics, chosen)


def run_full_analysis(
    spark: SparkSession, sessions: str, outcomes: str, event_log: str, data_folder: str, output: str, spec: PanelSpec,
    fmt: str = "parquet", rename=None, **options,
) -> Analysis:
    """Raw files to results: normalise, validate, materialise as Parquet, read back, analyse."""
    raw = read_raw_study(spark, sessions, outcomes, event_log, spec, fmt, rename)
    normal = normalize_study(*raw, spec)
    quality.require_clean(quality.panel_violations(*normal, spec))
    write_study(*normal, data_folder, spec)
    return run_analysis(*read_study(spark, data_folder, spec), spec, output, **options)
