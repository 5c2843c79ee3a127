"""Does the mean state of a subject rise with its arm? Tests, adjustments, negative controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.columns import arm_rank, hour_of_day
from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.sampling import stage_seed
from driftpanel.operators.hmm import FitRequest, fit_many, prepare
from driftpanel.operators.partial import partial_spearman
from driftpanel.operators.resample import resample
from driftpanel.operators.sequences import build_sequences, contiguous_prefix, fit_scaler, log_rows, restrict
from driftpanel.operators.states import decode, model_sequences, severity_order, state_index
from driftpanel.operators.stats import (
    auc_from_moments,
    class_profile,
    percentile_interval,
    rank_moments,
    rho_from_moments,
    score_profile,
    size_from_moments,
)
from driftpanel.spec import PanelSpec, study_options

BOOTSTRAP_ITERATIONS = 2_000
PERMUTATION_ITERATIONS = 5_000


def with_arm(index: DataFrame, outcomes: DataFrame) -> DataFrame:
    return index.join(by_key(outcomes.select("subject_id", "arm")), "subject_id")


def arm_profile(joined: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per distinct mean state, with a count per arm: all the order tests need."""
    return class_profile(joined, "mean_state_index", "arm", spec.arms)


def rho_draws(profile: DataFrame, spec: PanelSpec, kind: str, seed: int, iterations: int) -> DataFrame:
    """``iter, rho`` of each resample; NULL where one side became constant."""
    n = len(spec.arms)
    return resample(profile, n, kind, seed, iterations).select("iter", rho_from_moments(n).alias("rho"))


def null_summary(null: DataFrame, observed: DataFrame) -> DataFrame:
    """One-sided p-value, mean, and population deviation of a permutation null."""
    joined = null.where(F.col("rho").isNotNull()).crossJoin(F.broadcast(observed.select(F.col("rho").alias("_seen"))))
    return joined.agg(
        F.count(F.lit(1)).alias("n_permutations"),
        F.avg("rho").alias("null_mean"),
        F.stddev_pop("rho").alias("null_sd"),
        ((F.count_if(F.col("rho") >= F.col("_seen")) + 1) / (F.count(F.lit(1)) + 1)).alias("one_sided_p"),
    )


def primary_test(
    index: DataFrame,
    outcomes: DataFrame,
    spec: PanelSpec,
    seed: int,
    bootstrap: int = BOOTSTRAP_ITERATIONS,
    permutations: int = PERMUTATION_ITERATIONS,
) -> DataFrame:
    """Spearman rho of arm against mean state, bootstrap interval, and permutation null; one row."""
    n = len(spec.arms)
    profile = cut_lineage(arm_profile(with_arm(index, outcomes), spec))
    observed = rank_moments(profile, n).select(size_from_moments(n).alias("n"), rho_from_moments(n).alias("rho"))
    interval = percentile_interval(rho_draws(profile, spec, "bootstrap", seed, bootstrap), "rho")
    null = null_summary(rho_draws(profile, spec, "permutation", stage_seed(seed, "permutation"), permutations), observed)
    return observed.crossJoin(F.broadcast(interval)).crossJoin(F.broadcast(null))


def leave_one_arm_out(index: DataFrame, outcomes: DataFrame, spec: PanelSpec) -> DataFrame:
    """The order statistic without each arm in turn: ``held_out, n, rho``.

    The arm counts of each distinct mean state are replicated once per arm, not the subjects.
    """
    profile = arm_profile(with_arm(index, outcomes), spec)
    n = len(spec.arms)
    variants = []
    for held, arm in enumerate(spec.arms):
        kept = [(F.lit(0).cast("long") if i == held else F.col(f"n{i}")).alias(f"n{i}") for i in range(n)]
        size = (F.col("n") - F.col(f"n{held}")).alias("n")
        variants.append(F.struct(F.lit(arm).alias("held_out"), *kept, size))
    spread = profile.select("value", F.inline(F.array(*variants))).where(F.col("n") > 0)
    moments = rank_moments(spread, n, ["held_out"])
    return moments.select("held_out", size_from_moments(n).alias("n"), rho_from_moments(n).alias("rho"))


def subject_covariates(sessions: DataFrame) -> DataFrame:
    """First batch and clutch, mean time of day, shift, and noise per subject."""

    def earliest(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c)

    return sessions.groupBy("subject_id").agg(
        earliest("batch"),
        earliest("clutch"),
        F.avg(hour_of_day()).alias("mean_hour"),
        F.avg("shift").alias("mean_shift"),
        F.avg("noise").alias("mean_noise"),
    )


def covariate_adjusted(index: DataFrame, outcomes: DataFrame, sessions: DataFrame, spec: PanelSpec) -> DataFrame:
    joined = with_arm(index, outcomes).join(by_key(subject_covariates(sessions)), "subject_id", "left")
    ranked = joined.withColumn("arm_rank", arm_rank(spec).cast("double"))
    return partial_spearman(
        ranked, "arm_rank", "mean_state_index", ["mean_hour", "mean_shift", "mean_noise"], ["batch", "clutch"]
    )


def control_only_refit(
    sessions: DataFrame,
    outcomes: DataFrame,
    spec: PanelSpec,
    n_states: int,
    seed: int,
    restarts: int,
    n_iter: int = 160,
    bootstrap: int = BOOTSTRAP_ITERATIONS,
    permutations: int = PERMUTATION_ITERATIONS,
) -> DataFrame:
    """Fit on the control arm alone, decode everyone, repeat the order test."""
    controls = outcomes.where(F.col("arm") == spec.control_arm)
    prefix = contiguous_prefix(restrict(sessions, controls), spec)
    scaler = fit_scaler(prefix, spec)
    s = scaler.first()
    table = prepare(build_sequences(log_rows(prefix, spec), spec, carry=()))
    try:
        options = study_options(n_states, seed, restarts, n_iter)
        model = fit_many(table, [FitRequest(options, tuple(s.center), tuple(s.scale))])[0]
    finally:
        table.unpersist()
    fixed = sessions.sparkSession.createDataFrame([s])
    sequences = model_sequences(restrict(sessions, outcomes), fixed, spec)
    index = state_index(decode(sequences, model, severity_order(model, spec.features)))
    result = primary_test(index, outcomes, spec, seed, bootstrap, permutations)
    size = controls.agg(F.count(F.lit(1)).alias("n_control_subjects"))
    return result.crossJoin(F.broadcast(size)).withColumn("converged", F.lit(model.converged))


def forecast_draws(forecasts: DataFrame, seed: int, iterations: int, risk: str = "risk") -> DataFrame:
    """``iter, roc_auc, average_precision`` of subject bootstraps; NULL where one class is missing."""
    draws = resample(score_profile(forecasts, risk, "target"), 2, "bootstrap", seed, iterations, precision=True)
    both = (F.col("w0") > 0) & (F.col("w1") > 0)
    return draws.select("iter", auc_from_moments().alias("roc_auc"), F.when(both, F.col("ap")).alias("average_precision"))


def negative_controls(primary: DataFrame, refit: DataFrame, left_out: DataFrame) -> DataFrame:
    """Shuffled labels, control-only refit, and leave-one-arm-out as rows ``control, scope, metric, value``."""

    def rows(df: DataFrame, control: str, scope, metrics: dict[str, str]) -> DataFrame:
        entries = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()]
        return df.select(F.lit(control).alias("control"), scope.alias("scope"), F.inline(F.array(*entries)))

    shuffled = {
        "permutation_iterations": "n_permutations",
        "null_mean_rho": "null_mean",
        "null_sd_rho": "null_sd",
        "observed_rho": "rho",
        "one_sided_p": "one_sided_p",
    }
    whole = {**shuffled, "n_subjects": "n", "ci_low": "ci_low", "ci_high": "ci_high", "n_control_subjects": "n_control_subjects"}
    return (
        rows(primary, "label_shuffled", F.lit("all"), shuffled)
        .union(rows(refit, "control_only_refit", F.lit("all"), whole))
        .union(rows(left_out, "leave_one_arm_out", F.col("held_out"), {"n_subjects": "n", "rho": "rho"}))
    )
