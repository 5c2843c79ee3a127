"""Raw study tables to normalised sessions, outcomes, and behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.columns import clip
from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.ranks import exact_percentiles, with_constants
from driftpanel.spec import PanelSpec

SESSION_COLUMNS = (
    "subject_id", "arm", "batch", "clutch", "plate", "well", "baseline_t", "t", "days_since_baseline",
    "hours_since_baseline", "n_drops", "nominal_pressure", "pressure", "dose", "channel", "electrode_target",
    "impedance", "noise", "shift", "qc_pass", "sampling_rate", "recording_minutes", "artifact_fraction", "started_at",
)
RATE_COLUMNS = ("abnormal_rate", "severe_rate", "whirl_rate", "convulsion_rate")


def normalize_sessions(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keep-list projection; optional columns the source lacks are skipped."""
    kept = [c for c in (*SESSION_COLUMNS, *spec.features.columns) if c in raw.columns]
    return raw.select(*[F.col(c).cast("string").alias(c) if c in ("subject_id", "arm") else F.col(c) for c in kept])


def observed_subjects(sessions: DataFrame, event_log: DataFrame, spec: PanelSpec) -> DataFrame:
    """Ids seen in the target period by either table."""
    at_target = F.col("t") == spec.t_target
    return (
        sessions.where(at_target).select(F.col("subject_id").cast("string"))
        .union(event_log.where(at_target).select(F.col("subject_id").cast("string")))
        .distinct()
    )


def qualifying_subjects(event_log: DataFrame, spec: PanelSpec) -> DataFrame:
    hits = event_log.where(F.col("qualifies") & (F.col("t") == spec.t_target))
    return hits.select(F.col("subject_id").cast("string")).distinct()


def endpoint(sessions: DataFrame, event_log: DataFrame, spec: PanelSpec) -> DataFrame:
    """1 = a qualifying event in the target period, 0 = observed without one; unseen ids are absent."""
    positives = qualifying_subjects(event_log, spec).withColumn("_hit", F.lit(1))
    seen = observed_subjects(sessions, event_log, spec)
    return seen.join(by_key(positives), "subject_id", "left").select("subject_id", F.coalesce("_hit", F.lit(0)).alias("target"))


def subject_metadata(sessions: DataFrame) -> DataFrame:
    """One row per subject; each label is its earliest non-null value."""

    def earliest(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c)

    return sessions.groupBy("subject_id").agg(
        *[earliest(c) for c in ("arm", "batch", "clutch", "plate", "n_drops")],
        F.avg("pressure").alias("pressure"),
        F.max("dose").alias("dose"),
        F.max("t").alias("last_t"),
        F.count(F.lit(1)).alias("n_sessions"),
    )


def max_stage(event_log: DataFrame) -> DataFrame:
    return event_log.groupBy(F.col("subject_id").cast("string").alias("subject_id")).agg(F.max("stage").alias("max_stage"))


def normalize_outcomes(sessions: DataFrame, raw_outcomes: DataFrame, event_log: DataFrame, spec: PanelSpec) -> DataFrame:
    outcomes = raw_outcomes.withColumn("subject_id", F.col("subject_id").cast("string"))
    return (
        subject_metadata(sessions)
        .join(by_key(outcomes), "subject_id", "left")
        .join(by_key(endpoint(sessions, event_log, spec)), "subject_id", "left")
        .join(by_key(max_stage(event_log)), "subject_id", "left")
        .withColumns(
            {
                "survived": F.col("last_t") >= spec.t_target,
                "max_stage": F.coalesce(F.col("max_stage"), F.lit(0)).cast("int"),
            }
        )
    )


def flag_events(event_log: DataFrame) -> DataFrame:
    return event_log.withColumns(
        {
            "subject_id": F.col("subject_id").cast("string"),
            "minutes": F.col("session_duration_s").cast("double") / 60.0,
            "is_abnormal": F.col("stage") >= 1,
            "is_severe": F.col("stage") >= 2,
            "is_whirl": F.col("behavior_class") == "whirlpool",
            "is_convulsion": F.col("behavior_class") == "convulsion_posture_loss",
        }
    )


def aggregate_events(event_log: DataFrame) -> DataFrame:
    """One row per logged (subject, period); combined on the map side, so busy sessions stay cheap."""
    return flag_events(event_log).groupBy("subject_id", "t").agg(
        F.min("minutes").alias("session_minutes"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if("is_abnormal").alias("n_abnormal"),
        F.count_if("is_severe").alias("n_severe"),
        F.count_if("is_whirl").alias("n_whirl"),
        F.count_if("is_convulsion").alias("n_convulsion"),
        F.sum("event_duration_s").alias("event_seconds"),
        F.max("stage").alias("stage_max"),
        F.avg("mean_velocity").alias("mean_speed"),
        F.max("peak_velocity").alias("max_speed"),
        F.avg("rms_bend").alias("mean_bend"),
        F.max("max_bend").alias("max_bend"),
        F.avg("likelihood").alias("mean_likelihood"),
        F.bool_and("tracking_qc_pass").alias("tracking_qc_pass"),
    )


def session_scaffold(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("subject_id").cast("string"), "arm", "t").distinct()


def median_minutes(event_log: DataFrame) -> DataFrame:
    """One row ``minutes``: the exact median session length over all logged events, or 5 without any."""
    median = exact_percentiles(flag_events(event_log), ["minutes"], [0.5])
    return median.agg(F.coalesce(F.max("value"), F.lit(5.0)).alias("minutes"))


def materialize_silent_sessions(sessions: DataFrame, event_log: DataFrame) -> DataFrame:
    """Every recorded session, with or without logged events; missing counts become zero."""
    scaffold = session_scaffold(sessions)
    joined = scaffold.join(by_key(aggregate_events(event_log)), ["subject_id", "t"], "left")
    zero_filled = ["n_events", "n_abnormal", "n_severe", "n_whirl", "n_convulsion", "event_seconds", "stage_max"]
    filled = with_constants(joined.fillna(0, subset=zero_filled), median_minutes(event_log))
    return filled.withColumns(
        {
            "session_minutes": F.coalesce(F.col("session_minutes"), F.col("minutes")),
            "tracking_qc_pass": F.coalesce(F.col("tracking_qc_pass"), F.lit(True)),
        }
    ).drop("minutes")


def add_rates(behavior: DataFrame) -> DataFrame:
    minutes = F.col("session_minutes")
    return behavior.withColumns(
        {
            "abnormal_rate": F.col("n_abnormal") / minutes,
            "severe_rate": F.col("n_severe") / minutes,
            "whirl_rate": F.col("n_whirl") / minutes,
            "convulsion_rate": F.col("n_convulsion") / minutes,
            "rest_fraction": clip(1.0 - F.col("event_seconds") / (minutes * 60.0), 0.0, 1.0),
        }
    )


def add_abnormality(behavior: DataFrame) -> DataFrame:
    """Mean of four rates, each over its own 0.9 quantile, and stage over 3; rounded to six places."""
    quantiles = exact_percentiles(behavior, RATE_COLUMNS, [0.9])
    usable = F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(1.0))
    reference = quantiles.agg(*[F.max(F.when(F.col("feature") == c, usable)).alias(f"_q_{c}") for c in RATE_COLUMNS])
    terms = [F.col(c) / F.col(f"_q_{c}") for c in RATE_COLUMNS] + [F.col("stage_max") / 3.0]
    scored = with_constants(behavior, reference)
    scored = scored.withColumn("abnormality", F.round(sum(terms[1:], terms[0]) / len(terms), 6))
    return scored.drop(*[f"_q_{c}" for c in RATE_COLUMNS])


def normalize_behavior(sessions: DataFrame, event_log: DataFrame) -> DataFrame:
    """One row per recorded session.

    The session table is written before its quantiles are taken, so the event log, which is far
    larger, is not aggregated a second time.
    """
    return add_abnormality(cut_lineage(add_rates(materialize_silent_sessions(sessions, event_log))))


def cohort_manifest(outcomes: DataFrame) -> DataFrame:
    """Counts of the whole cohort (arm is NULL) and of each arm."""
    rolled = outcomes.groupingSets([[], ["arm"]], "arm").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.count_if(F.col("target") == 1).alias("n_positive"),
        F.count_if(F.col("target") == 0).alias("n_negative"),
        F.count_if(F.col("target").isNull()).alias("n_unresolved"),
    )
    return rolled
