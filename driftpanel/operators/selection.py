"""Choice of the number of states by train-only BIC and cross-validated likelihood."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.joins import by_key
from driftpanel.functions.sampling import stage_seed
from driftpanel.operators.hmm import FitRequest, HmmModel, fit_many, prepare
from driftpanel.operators.sequences import build_sequences, contiguous_prefix, fit_scaler, log_rows, restrict
from driftpanel.spec import PanelSpec, study_options


def parameter_count(n_states: Column, n_features: int) -> Column:
    """Free parameters: start, transitions, means and variances."""
    return (n_states - 1) + n_states * (n_states - 1) + 2 * n_states * n_features


def bic(loglik: Column, n_parameters: Column, n_sessions: Column) -> Column:
    return -2.0 * loglik + n_parameters * F.log(n_sessions.cast("double"))


def best_state_count(selection: DataFrame) -> DataFrame:
    """State count with the smallest BIC, the smaller count on ties."""
    return selection.agg(F.min(F.struct("bic", "n_states")).alias("_b")).select(F.col("_b.n_states").alias("n_states"))


def best_restart(fits: DataFrame) -> DataFrame:
    """Restart with the largest log likelihood, the first on ties; one row per state count."""
    best = F.max(F.struct("loglik", (-F.col("restart")).alias("_first")))
    return fits.groupBy("n_states").agg(best.alias("_b")).select(
        "n_states", (-F.col("_b._first")).alias("restart"), F.col("_b.loglik").alias("loglik")
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean, sample deviation, and standard error of the per-session fold likelihoods."""
    sd = F.coalesce(F.stddev_samp("loglik_per_session"), F.lit(0.0))
    return folds.groupBy("n_states").agg(
        F.avg("loglik_per_session").alias("cv_loglik_per_session"),
        sd.alias("cv_sd"),
        (sd / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("cv_se"),
    )


@dataclass
class Selection:
    """Chosen model, every full-data model, the train scaler, and the comparison table."""

    n_states: int
    models: dict[int, HmmModel]
    scaler: DataFrame
    table: DataFrame
    folds: DataFrame

    @property
    def model(self) -> HmmModel:
        return self.models[self.n_states]


def training_sets(train_prefix: DataFrame, folds: int) -> DataFrame:
    """Each row once for the full set (-1) and once for each fold that does not hold it out."""
    sets = F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.lit(folds - 1)))
    return train_prefix.withColumn("set_id", F.explode(sets)).where(F.col("set_id") != F.col("fold"))


def select_state_count(
    sessions: DataFrame,
    folds: DataFrame,
    spec: PanelSpec,
    candidates: Sequence[int] = (2, 3),
    seed: int = 42,
    restarts: int = 3,
    cv_folds: int = 3,
    n_iter: int = 160,
    fold_n_iter: int = 130,
) -> Selection:
    """Fit every candidate on all train subjects and on each fold's complement, all in shared passes.

    ``folds`` is ``subject_id, fold`` of the train subjects. Scalers are refitted inside each fold.
    """
    spark = sessions.sparkSession
    candidates = sorted({int(c) for c in candidates})
    prefix = contiguous_prefix(restrict(sessions, folds), spec).join(by_key(folds.select("subject_id", "fold")), "subject_id")
    # (folds + 1) rows of 2 x features numbers
    scalers = {r.set_id: r for r in fit_scaler(training_sets(prefix, cv_folds), spec, ["set_id"]).collect()}
    table = prepare(
        build_sequences(log_rows(prefix, spec), spec, carry=("fold",)).withColumn("fold", F.get("fold", F.lit(0))), fold="fold"
    )
    requests, labels = [], []
    for k in candidates:
        for fold in (-1, *range(cv_folds)):
            if fold < 0:
                options = study_options(k, stage_seed(seed, "states", k), restarts, n_iter)
            else:
                options = study_options(k, stage_seed(seed, "states", k, fold), max(1, restarts - 1), fold_n_iter)
            s = scalers[fold]
            requests.append(FitRequest(options, tuple(s.center), tuple(s.scale), None if fold < 0 else fold))
            labels.append((k, fold))
    try:
        fitted = dict(zip(labels, fit_many(table, requests)))
        n_sessions = table.agg(F.sum(F.size("zs"))).first()[0]
    finally:
        table.unpersist()
    fold_rows = [
        (k, f, m.held_out[0] / m.held_out[1]) for (k, f), m in fitted.items() if f >= 0 and m.held_out[1] > 0
    ]
    fold_table = spark.createDataFrame(fold_rows, "n_states int, fold int, loglik_per_session double")
    full_rows = [(k, m.log_likelihood, int(n_sessions)) for (k, f), m in fitted.items() if f < 0]
    full = spark.createDataFrame(full_rows, "n_states int, loglik double, n_sessions long")
    d = len(spec.features.columns)
    full = full.withColumn("n_parameters", parameter_count(F.col("n_states"), d)).withColumn(
        "bic", bic(F.col("loglik"), F.col("n_parameters"), F.col("n_sessions"))
    )
    comparison = full.join(fold_summary(fold_table), "n_states", "left")
    chosen = best_state_count(comparison).first().n_states
    s = scalers[-1]
    scaler = spark.createDataFrame([(s.center, s.scale)], "center array<double>, scale array<double>")
    return Selection(chosen, {k: m for (k, f), m in fitted.items() if f < 0}, scaler, comparison, fold_table)
