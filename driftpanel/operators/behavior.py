"""Forecast risk against behaviour in the target period, raw and adjusted; dynamics report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.joins import by_key
from driftpanel.operators.partial import partial_spearman
from driftpanel.operators.stats import spearman
from driftpanel.spec import PanelSpec

CARRIED = ("abnormality", "mean_speed", "rest_fraction", "whirl_rate", "stage_max")


def target_behavior(behavior: DataFrame, spec: PanelSpec) -> DataFrame:
    """Behaviour rows of the target period that pass tracking quality control."""
    kept = [c for c in CARRIED if c in behavior.columns]
    return behavior.where((F.col("t") == spec.t_target) & F.col("tracking_qc_pass")).select("subject_id", *kept)


def merge_behavior(forecasts: DataFrame, behavior: DataFrame, spec: PanelSpec) -> DataFrame:
    return forecasts.join(by_key(target_behavior(behavior, spec)), "subject_id")


def behavior_rho(merged: DataFrame) -> DataFrame:
    return spearman(merged, "risk", "abnormality")


def adjusted_behavior_rho(merged: DataFrame) -> DataFrame:
    """Partial rho after removing log dose, arm, and batch."""
    table = merged.withColumn("log_dose", F.log1p("dose"))
    return partial_spearman(table, "risk", "abnormality", ["log_dose"], ["arm", "batch"])


def dose_risk_rho(forecasts: DataFrame) -> DataFrame:
    return spearman(forecasts, "dose", "risk")


def compare_models(forecast_metrics: DataFrame, baseline_metrics: DataFrame) -> DataFrame:
    """Which model is ahead on each metric; inputs are rows ``metric, value``."""
    f = forecast_metrics.select("metric", F.col("value").alias("forecast"))
    b = baseline_metrics.select("metric", F.col("value").alias("baseline"))
    lower_wins = F.col("metric").contains("brier")
    ahead = F.when(lower_wins, F.col("forecast") < F.col("baseline")).otherwise(F.col("forecast") > F.col("baseline"))
    tied = F.col("forecast") == F.col("baseline")
    winner = F.when(tied, "tie").when(ahead, "forecast").otherwise("baseline")
    return f.join(b, "metric").withColumn("ahead", winner)
