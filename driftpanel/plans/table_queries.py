"""Queries over raw and normalised tables: scans, predicates, quality, joins, aggregates, sets."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.columns import alarm, arm_rank, hour_of_day, r6, state_label, stratum
from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import shared_folder
from driftpanel.functions.ranks import with_constants
from driftpanel.operators import normalize as norm
from driftpanel.operators import quality, states as st, stats
from driftpanel.operators.baseline import predict_baseline
from driftpanel.operators.behavior import merge_behavior, target_behavior
from driftpanel.operators.ordering import subject_covariates, with_arm
from driftpanel.operators.sequences import landmark, qc_sessions, restrict, scale_rows
from driftpanel.plans.analysis import dataset_summary, landmark_vectors, survival_by_arm
from driftpanel.plans.context import FIXED_BASELINE
from driftpanel.plans.oracle import FEATURES, r6 as sql6
from driftpanel.plans.registry import query
from driftpanel.sources.sinks import manifest_document, metrics_document, write_results, write_study
from driftpanel.sources.tables import in_fixed_order, read_raw_study, read_study



def _log_features():
    return [r6(F.log1p(F.col(c))).alias(f"log_{c}") for c in FEATURES]


_SQL_LOG = ", ".join(f"{sql6(f'ln(1 + {f})')} AS log_{f}" for f in FEATURES)


def _n():
    return F.count(F.lit(1))


def _scratch(ctx) -> str:
    """A fresh folder for a written table, beside the study's other intermediate tables."""
    return f"{shared_folder(ctx.spark)}/driftpanel-{uuid.uuid4().hex}"


# --- scans and sinks -------------------------------------------------------------------


@query("io1_raw_tables", ["sessions", "log", "raw_outcomes"],
       "SELECT 'sessions' AS tbl, count(*) AS n, count(DISTINCT subject_id) AS n_subjects FROM sessions "
       "UNION ALL SELECT 'event_log', count(*), count(DISTINCT subject_id) FROM log "
       "UNION ALL SELECT 'outcomes', count(*), count(DISTINCT subject_id) FROM raw_outcomes")
def io1(ctx):
    """Raw tables are written as files and read back with declared schemas."""
    folder = _scratch(ctx)
    raw = {"sessions": ctx.raw.sessions, "outcomes": ctx.raw.outcomes, "event_log": ctx.raw.event_log}
    for name, df in raw.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    read = read_raw_study(ctx.spark, *[f"{folder}/{n}" for n in ("sessions", "outcomes", "event_log")], ctx.spec)
    named = zip(("sessions", "outcomes", "event_log"), read)
    parts = [df.agg(_n().alias("n"), F.count_distinct("subject_id").alias("n_subjects")).select(F.lit(n).alias("tbl"), "n", "n_subjects") for n, df in named]
    return parts[0].union(parts[1]).union(parts[2])


@query("io2_normalised_sessions", ["sessions"],
       f"SELECT subject_id, t, arm, qc_pass, {_SQL_LOG} FROM sessions ORDER BY subject_id, t")
def io2(ctx):
    folder = _scratch(ctx)
    write_study(ctx.sessions, ctx.outcomes, ctx.behavior, folder, ctx.spec)
    sessions, _, _ = in_fixed_order(*read_study(ctx.spark, folder, ctx.spec))
    return sessions.select("subject_id", "t", "arm", "qc_pass", *_log_features())


@query("io3_written_tables", ["sessions", "outcomes", "behavior"],
       f"SELECT 'sessions' AS tbl, count(*) AS n, {sql6('sum(dose)')} AS checksum FROM sessions "
       f"UNION ALL SELECT 'outcomes', count(*), {sql6('sum(dose)')} FROM outcomes "
       f"UNION ALL SELECT 'behavior', count(*), {sql6('sum(abnormality)')} FROM behavior")
def io3(ctx):
    """The normalised tables after a round trip through files."""
    folder = _scratch(ctx)
    write_study(ctx.sessions, ctx.outcomes, ctx.behavior, folder, ctx.spec)
    sessions, outcomes, behavior = read_study(ctx.spark, folder, ctx.spec)
    parts = [
        df.agg(_n().alias("n"), r6(F.sum(c)).alias("checksum")).select(F.lit(n).alias("tbl"), "n", "checksum")
        for n, df, c in (("sessions", sessions, "dose"), ("outcomes", outcomes, "dose"), ("behavior", behavior, "abnormality"))
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("io4_manifest", ["sessions", "outcomes", "behavior"],
       "SELECT (SELECT count(*) FROM outcomes) AS n_subjects, (SELECT count(*) FROM sessions) AS n_sessions, "
       "(SELECT count(*) FROM behavior) AS n_behavior_sessions, (SELECT count(*) FROM outcomes WHERE target = 1) AS n_positive, "
       "(SELECT count(*) FROM outcomes WHERE target IS NULL) AS n_unresolved, (SELECT count(*) FROM outcomes WHERE arm = 'a1' AND target = 1) AS a1_positive")
def io4(ctx):
    document = manifest_document(ctx.sessions, ctx.outcomes, ctx.behavior, ctx.spec)
    at = {"n_subjects": "$.n_subjects", "n_sessions": "$.n_sessions", "n_behavior_sessions": "$.n_behavior_sessions",
          "n_positive": "$.n_positive", "n_unresolved": "$.n_unresolved", "a1_positive": "$.arms.a1.n_positive"}
    return document.select(*[F.get_json_object("value", path).cast("long").alias(c) for c, path in at.items()])


_RESULT_COUNTS = {
    "split_assignments": "outcomes",
    "scored_sessions": "test_scored",
    "early_predictions": "forecasts",
    "state_index": "state_index",
    "baseline_predictions": "(SELECT DISTINCT subject_id FROM scaled JOIN outcomes USING (subject_id) WHERE target IS NOT NULL AND scaled.t <= 5 AND subject_id IN (SELECT subject_id FROM test))",
    "state_occupancy": "(SELECT DISTINCT arm, t FROM test_scored)",
    "group_transitions": "(VALUES ('a0'), ('a1'), ('a2'), ('a3'))",
    "transition_matrix": "(SELECT DISTINCT i FROM steps)",
}


@query("io5_result_tables", ["outcomes", "test_scored", "forecasts", "state_index", "scaled", "test", "steps"],
       " UNION ALL ".join(f"SELECT '{name}' AS tbl, count(*) AS n FROM {source}" for name, source in _RESULT_COUNTS.items()))
def io5(ctx):
    """Result tables after a round trip through files."""
    folder = _scratch(ctx)
    vectors = landmark_vectors(ctx.usable, ctx.outcomes, ctx.scaler, ctx.spec)
    steps = st.parameter_tables(ctx.sessions, ctx.model, ctx.order, ctx.spec)["transition"]
    tables = {
        "split_assignments": ctx.assignments,
        "scored_sessions": ctx.scored,
        "early_predictions": ctx.forecasts,
        "state_index": ctx.index,
        "baseline_predictions": predict_baseline(restrict(vectors, ctx.test), FIXED_BASELINE),
        "state_occupancy": st.occupancy(ctx.scored, ctx.model.n_states),
        "group_transitions": st.transition_summary(ctx.scored, ctx.spec),
        "transition_matrix": st.transition_wide(steps, ctx.model.n_states),
    }
    metrics = dataset_summary(ctx.sessions, ctx.outcomes, ctx.spec).select(
        F.lit("dataset").alias("section"), F.lit("all").alias("scope"), F.lit("n_sessions").alias("metric"), F.col("n_sessions").cast("double").alias("value")
    )
    write_results(tables, metrics, folder)
    parts = [ctx.spark.read.parquet(f"{folder}/tables/{n}").agg(_n().alias("n")).select(F.lit(n).alias("tbl"), "n") for n in tables]
    return reduce(DataFrame.union, parts)


@query("io6_metrics_document", ["outcomes"],
       f"SELECT arm, {sql6('avg(CAST(survived AS INTEGER))')} AS survival_rate FROM outcomes GROUP BY arm")
def io6(ctx):
    """Survival rates read back out of the nested JSON document."""
    rates = survival_by_arm(ctx.outcomes).select(
        F.lit("survival").alias("section"), F.col("arm").alias("scope"), F.lit("rate").alias("metric"), F.col("survival_rate").alias("value")
    )
    parsed = metrics_document(rates).select(F.from_json("value", "map<string,map<string,map<string,double>>>").alias("m"))
    arms = parsed.select(F.explode(F.element_at("m", "survival")).alias("arm", "v"))
    return arms.select("arm", r6(F.element_at("v", "rate")).alias("survival_rate"))


# --- projections, filters, predicates ---------------------------------------------------


@query("pf1_keep_list", ["sessions"],
       f"SELECT subject_id, arm, batch, clutch, plate, baseline_t, t, n_drops, {sql6('pressure')} AS pressure, dose, qc_pass FROM sessions")
def pf1(ctx):
    wider = ctx.raw.sessions.withColumn("not_in_the_keep_list", F.lit(1))
    kept = norm.normalize_sessions(wider, ctx.spec)
    shown = [c for c in kept.columns if c not in (*FEATURES, "started_at", "shift", "noise")]
    return kept.select(*[r6(c).alias(c) if c == "pressure" else F.col(c) for c in shown])


@query("pf2_qc_rule", ["sessions"], f"SELECT subject_id, t, {sql6('shift')} AS shift, shift <= 50 AND noise < 0.2 AS expected_pass FROM sessions")
def pf2(ctx):
    return ctx.lazy_sessions.select("subject_id", "t", r6("shift").alias("shift"), ((F.col("shift") <= 50.0) & (F.col("noise") < 0.2)).alias("expected_pass"))


@query("pf3_usable_sessions", ["usable"], f"SELECT subject_id, t, {_SQL_LOG} FROM usable")
def pf3(ctx):
    return qc_sessions(ctx.lazy_sessions).select("subject_id", "t", *_log_features())


@query("pf4_cutoff", ["usable"], "SELECT arm, t, count(*) AS n FROM usable WHERE t <= 5 GROUP BY arm, t")
def pf4(ctx):
    return qc_sessions(ctx.lazy_sessions).where(F.col("t") <= ctx.spec.t_cutoff).groupBy("arm", "t").agg(_n().alias("n"))


@query("pf5_qualifying_events", ["log"], "SELECT subject_id, count(*) AS n FROM log WHERE qualifies AND t = 6 GROUP BY subject_id")
def pf5(ctx):
    hits = ctx.raw.event_log.where(F.col("qualifies") & (F.col("t") == ctx.spec.t_target))
    return hits.groupBy("subject_id").agg(_n().alias("n"))


@query("pf6_event_flags", ["log"],
       f"SELECT subject_id, t, {sql6('session_duration_s / 60')} AS minutes, stage >= 1 AS is_abnormal, stage >= 2 AS is_severe, "
       f"behavior_class = 'whirlpool' AS is_whirl, behavior_class = 'convulsion_posture_loss' AS is_convulsion, {sql6('event_duration_s')} AS seconds FROM log")
def pf6(ctx):
    flagged = norm.flag_events(ctx.raw.event_log)
    return flagged.select("subject_id", "t", r6("minutes").alias("minutes"), "is_abnormal", "is_severe", "is_whirl", "is_convulsion", r6("event_duration_s").alias("seconds"))


@query("pf7_known_targets", ["assigned"], "SELECT subject_id, arm, target, split FROM assigned WHERE target IS NOT NULL AND split = 'test'")
def pf7(ctx):
    return ctx.test.where(F.col("target").isNotNull()).select("subject_id", "arm", "target", "split")


@query("pf8_target_behavior", ["behavior"],
       f"SELECT subject_id, abnormality + 0.0 AS abnormality, {sql6('rest_fraction')} AS rest_fraction, stage_max FROM behavior WHERE t = 6 AND tracking_qc_pass")
def pf8(ctx):
    return target_behavior(ctx.behavior, ctx.spec).select("subject_id", r6("abnormality").alias("abnormality"), r6("rest_fraction").alias("rest_fraction"), "stage_max")


@query("pf9_rates", ["rates"], "SELECT subject_id, t, " + ", ".join(f"{sql6(c)} AS {c}" for c in (*norm.RATE_COLUMNS, "rest_fraction")) + " FROM rates")
def pf9(ctx):
    rated = norm.add_rates(norm.materialize_silent_sessions(ctx.sessions, ctx.raw.event_log))
    return rated.select("subject_id", "t", *[r6(c).alias(c) for c in (*norm.RATE_COLUMNS, "rest_fraction")])


@query("pf10_filled_sessions", ["filled"],
       f"SELECT subject_id, t, {sql6('session_minutes')} AS session_minutes, n_events, n_severe, {sql6('event_seconds')} AS event_seconds, stage_max, tracking_qc_pass FROM filled")
def pf10(ctx):
    filled = norm.materialize_silent_sessions(ctx.sessions, ctx.raw.event_log)
    return filled.select("subject_id", "t", r6("session_minutes").alias("session_minutes"), "n_events", "n_severe", r6("event_seconds").alias("event_seconds"), "stage_max", "tracking_qc_pass")


@query("pf11_survived", ["outcomes"], "SELECT subject_id, last_t, survived FROM outcomes")
def pf11(ctx):
    return ctx.outcomes.select("subject_id", "last_t", "survived")


@query("pf12_stratum", ["picked"], "SELECT stratum, count(*) AS n FROM picked GROUP BY stratum")
def pf12(ctx):
    return ctx.outcomes.groupBy(stratum().alias("stratum")).agg(_n().alias("n"))


@query("pf13_arm_rank", ["outcomes"], "SELECT subject_id, CAST(substr(arm, 2) AS INTEGER) AS arm_rank FROM outcomes")
def pf13(ctx):
    return ctx.outcomes.select("subject_id", arm_rank(ctx.spec).alias("arm_rank"))


@query("pf14_arm_filters", ["outcomes"],
       "SELECT 'control' AS part, count(*) AS n, avg(dose) AS mean_dose FROM outcomes WHERE arm = 'a0' UNION ALL SELECT 'without_control', count(*), avg(dose) FROM outcomes WHERE arm <> 'a0'")
def pf14(ctx):
    control = F.col("arm") == ctx.spec.control_arm
    part = F.when(control, "control").otherwise("without_control")
    return ctx.outcomes.groupBy(part.alias("part")).agg(_n().alias("n"), F.avg("dose").alias("mean_dose"))


@query("pf15_alarm", ["forecasts"], "SELECT subject_id, risk >= 0.5 AS called FROM forecasts")
def pf15(ctx):
    return ctx.forecasts.select("subject_id", alarm("risk").alias("called"))


@query("pf16_hour_of_day", ["sessions"], f"SELECT subject_id, t, {sql6('hour(started_at) + minute(started_at) / 60.0::DOUBLE')} AS hour FROM sessions")
def pf16(ctx):
    return ctx.lazy_sessions.select("subject_id", "t", r6(hour_of_day()).alias("hour"))


@query("pf17_state_label", ["test_scored"],
       "SELECT subject_id, t, state || ' (' || CASE state WHEN 0 THEN 'Baseline / low-amplitude' WHEN 1 THEN 'Transitional / latent-like' ELSE 'Hyperexcitable / ictal-like' END || ')' AS label FROM test_scored")
def pf17(ctx):
    return ctx.scored.select("subject_id", "t", state_label(F.col("state"), ctx.model.n_states).alias("label"))


# --- data quality -----------------------------------------------------------------------


@query("dq1_required_columns", ["sessions", "outcomes", "behavior"],
       "SELECT 'sessions' AS tbl, 0 AS n_missing, count(*) AS n_rows FROM sessions UNION ALL SELECT 'outcomes', 0, count(*) FROM outcomes "
       "UNION ALL SELECT 'behavior', 0, count(*) FROM behavior UNION ALL SELECT 'leaked_features', 0, 0")
def dq1(ctx):
    missing = quality.missing_columns(ctx.sessions, ctx.outcomes, ctx.behavior, ctx.spec)
    sizes = {"sessions": ctx.sessions, "outcomes": ctx.outcomes, "behavior": ctx.behavior}
    parts = [df.agg(_n().alias("n_rows")).select(F.lit(n).alias("tbl"), F.lit(len(missing[n])).alias("n_missing"), "n_rows") for n, df in sizes.items()]
    leaked = ctx.spark.range(1).select(F.lit("leaked_features").alias("tbl"), F.lit(len(missing["leaked_features"])).alias("n_missing"), F.lit(0).cast("long").alias("n_rows"))
    return parts[0].union(parts[1]).union(parts[2]).union(leaked)


def _rule(ctx, *names):
    # a deliberately wrong study description makes the rules count something
    return quality.session_violations(ctx.raw.sessions, ctx.spec).where(F.col("rule").isin(list(names)))


def _strict(ctx, **changes):
    from dataclasses import replace

    return quality.session_violations(ctx.raw.sessions, replace(ctx.spec, **changes))


@query("dq2_periods", ["sessions"], "SELECT 'period_outside_window' AS rule, count(*) AS n_bad FROM sessions WHERE t NOT IN (4, 5)")
def dq2(ctx):
    return _strict(ctx, periods=(4, 5)).where(F.col("rule") == "period_outside_window")


@query("dq3_baseline_period", ["sessions"], "SELECT 'wrong_baseline_period' AS rule, count(*) FILTER (WHERE baseline_t <> 3) AS n_bad FROM sessions")
def dq3(ctx):
    return _rule(ctx, "wrong_baseline_period")


@query("dq4_duplicates", ["log"],
       "SELECT 'duplicate_session' AS rule, CAST(sum(n - 1) AS BIGINT) AS n_bad FROM (SELECT count(*) AS n FROM log GROUP BY subject_id, t)")
def dq4(ctx):
    """Counted on the event log, where a subject's period does repeat."""
    return quality.duplicate_sessions(ctx.raw.event_log)


@query("dq5_arms", ["sessions"], "SELECT 'unknown_arm' AS rule, count(*) AS n_bad FROM sessions WHERE arm NOT IN ('a0', 'a1', 'a2')")
def dq5(ctx):
    return _strict(ctx, arms=("a0", "a1", "a2")).where(F.col("rule") == "unknown_arm")


@query("dq6_finite", ["sessions"], "SELECT 'feature_not_finite' AS rule, count(*) AS n_bad FROM sessions WHERE f_var = 0")
def dq6(ctx):
    """Log of a zero variance is minus infinity; the rule must find exactly those rows."""
    logged = ctx.raw.sessions.withColumn("f_var", F.when(F.col("f_var") == 0, F.lit(float("-inf"))).otherwise(F.log("f_var")))
    return quality.session_violations(logged, ctx.spec).where(F.col("rule") == "feature_not_finite")


@query("dq7_non_negative", ["sessions"],
       "SELECT 'negative_feature' AS rule, count(*) FILTER (WHERE f_rate - 1 < 0) AS n_bad FROM sessions UNION ALL SELECT 'negative_session_dose', count(*) FILTER (WHERE dose - 105 < 0) FROM sessions")
def dq7(ctx):
    shifted = ctx.raw.sessions.withColumns({"f_rate": F.col("f_rate") - 1, "dose": F.col("dose") - 105})
    return quality.session_violations(shifted, ctx.spec).where(F.col("rule").isin("negative_feature", "negative_session_dose"))


@query("dq8_qc_flag", ["sessions"], "SELECT 'qc_flag_differs_from_rule' AS rule, count(*) AS n_bad FROM sessions WHERE (shift <= 30) <> qc_pass")
def dq8(ctx):
    return _strict(ctx, max_shift=30.0).where(F.col("rule") == "qc_flag_differs_from_rule")


@query("dq9_orphans", ["sessions", "outcomes", "behavior"],
       "SELECT 'session_without_outcome' AS rule, count(DISTINCT subject_id) AS n_bad FROM sessions WHERE subject_id NOT IN (SELECT subject_id FROM outcomes WHERE target = 1) "
       "UNION ALL SELECT 'behavior_without_outcome', count(DISTINCT subject_id) FROM behavior WHERE subject_id NOT IN (SELECT subject_id FROM outcomes WHERE target = 1)")
def dq9(ctx):
    return quality.orphans(ctx.sessions, ctx.outcomes.where(F.col("target") == 1), ctx.behavior)


@query("dq10_target", ["outcomes"],
       "SELECT 'no_resolved_target' AS rule, CASE WHEN count(target) = 0 THEN 1 ELSE 0 END::BIGINT AS n_bad FROM outcomes "
       "UNION ALL SELECT 'target_mostly_unresolved', CASE WHEN count(target) < 0.5 * count(*) THEN 1 ELSE 0 END FROM outcomes "
       "UNION ALL SELECT 'target_has_one_class', CASE WHEN count(DISTINCT target) < 2 THEN 1 ELSE 0 END FROM outcomes "
       "UNION ALL SELECT 'negative_outcome_dose', count(*) FILTER (WHERE dose < 0) FROM outcomes")
def dq10(ctx):
    return quality.target_violations(ctx.outcomes)


@query("dq11_split", ["assigned", "outcomes"],
       "SELECT 'subject_in_both_parts' AS rule, count(*) AS n_bad FROM (SELECT subject_id FROM assigned GROUP BY subject_id HAVING count(DISTINCT split) > 1) "
       "UNION ALL SELECT 'subject_without_part', count(*) FROM outcomes WHERE subject_id NOT IN (SELECT subject_id FROM assigned) "
       "UNION ALL SELECT 'empty_train', CASE WHEN count(*) FILTER (WHERE split = 'train') = 0 THEN 1 ELSE 0 END FROM assigned "
       "UNION ALL SELECT 'empty_test', CASE WHEN count(*) FILTER (WHERE split = 'test') = 0 THEN 1 ELSE 0 END FROM assigned")
def dq11(ctx):
    return quality.split_violations(ctx.assignments, ctx.outcomes)


@query("dq12_forecast", ["forecasts"],
       "SELECT 'used_period_after_cutoff' AS rule, count(*) FILTER (WHERE last_t > 5) AS n_bad FROM forecasts UNION ALL SELECT 'no_forecast_horizon', count(*) FILTER (WHERE steps <= 0) FROM forecasts "
       "UNION ALL SELECT 'test_has_one_class', CASE WHEN count(DISTINCT target) < 2 THEN 1 ELSE 0 END FROM forecasts")
def dq12(ctx):
    return quality.forecast_violations(ctx.forecasts, ctx.spec)


@query("dq13_one_to_one", ["behavior"], "SELECT 'repeated_behavior' AS rule, count(*) AS n_bad FROM (SELECT subject_id FROM behavior GROUP BY subject_id HAVING count(*) > 1)")
def dq13(ctx):
    return quality.repeated_keys(ctx.behavior, "subject_id", "repeated_behavior")


# --- joins ------------------------------------------------------------------------------


@query("jn1_metadata_outcomes", ["metadata", "raw_outcomes"],
       f"SELECT subject_id, arm, batch, {sql6('pressure')} AS pressure, n_sessions, became_positive FROM metadata LEFT JOIN raw_outcomes USING (subject_id)")
def jn1(ctx):
    joined = norm.subject_metadata(ctx.sessions).join(by_key(ctx.raw.outcomes), "subject_id", "left")
    return joined.select("subject_id", "arm", "batch", r6("pressure").alias("pressure"), "n_sessions", "became_positive")


@query("jn2_endpoint_lookup", ["metadata", "endpoint"], "SELECT subject_id, target FROM metadata LEFT JOIN endpoint USING (subject_id)")
def jn2(ctx):
    targets = norm.endpoint(ctx.sessions, ctx.raw.event_log, ctx.spec)
    return norm.subject_metadata(ctx.sessions).join(by_key(targets), "subject_id", "left").select("subject_id", "target")


@query("jn3_stage_lookup", ["metadata", "stages"], "SELECT subject_id, coalesce(max_stage, 0) AS max_stage FROM metadata LEFT JOIN stages USING (subject_id)")
def jn3(ctx):
    joined = norm.subject_metadata(ctx.sessions).join(by_key(norm.max_stage(ctx.raw.event_log)), "subject_id", "left")
    return joined.select("subject_id", F.coalesce("max_stage", F.lit(0)).alias("max_stage"))


@query("jn4_silent_sessions", ["filled"], "SELECT subject_id, t, arm, n_events, n_events = 0 AS silent FROM filled")
def jn4(ctx):
    filled = norm.materialize_silent_sessions(ctx.sessions, ctx.raw.event_log)
    return filled.select("subject_id", "t", "arm", "n_events", (F.col("n_events") == 0).alias("silent"))


@query("jn5_forecast_behavior", ["merged_behavior"], f"SELECT subject_id, {sql6('risk')} AS risk, {sql6('abnormality')} AS abnormality FROM merged_behavior")
def jn5(ctx):
    merged = merge_behavior(ctx.forecasts, ctx.behavior, ctx.spec)
    return merged.select("subject_id", r6("risk").alias("risk"), r6("abnormality").alias("abnormality"))


@query("jn6_index_arm", ["ranked_index"], f"SELECT subject_id, {sql6('y')} AS mean_state_index, arm FROM ranked_index")
def jn6(ctx):
    return with_arm(ctx.index, ctx.outcomes).select("subject_id", r6("mean_state_index").alias("mean_state_index"), "arm")


_COVARIATES = {
    "covariates": (
        ["usable"],
        "SELECT subject_id, arg_min(batch, t) AS batch, arg_min(clutch, t) AS clutch, avg(hour(started_at) + minute(started_at) / 60.0::DOUBLE) AS mean_hour, "
        "avg(shift) AS mean_shift, avg(noise) AS mean_noise FROM usable GROUP BY subject_id",
    )
}


@query("jn7_index_covariates", ["state_index", "covariates"],
       f"SELECT subject_id, {sql6('mean_state_index')} AS mean_state_index, batch, clutch, {sql6('mean_hour')} AS mean_hour FROM state_index LEFT JOIN covariates USING (subject_id)", extra=_COVARIATES)
def jn7(ctx):
    joined = ctx.index.join(by_key(subject_covariates(ctx.usable)), "subject_id", "left")
    return joined.select("subject_id", r6("mean_state_index").alias("mean_state_index"), "batch", "clutch", r6("mean_hour").alias("mean_hour"))


@query("jn8_index_export", ["state_index", "outcomes"],
       f"SELECT i.subject_id, {sql6('mean_state_index')} AS mean_state_index, i.n_sessions, o.arm FROM state_index i LEFT JOIN outcomes o USING (subject_id)")
def jn8(ctx):
    joined = ctx.index.join(by_key(ctx.outcomes.select("subject_id", "arm")), "subject_id", "left")
    return joined.select("subject_id", r6("mean_state_index").alias("mean_state_index"), "n_sessions", "arm")


@query("jn9_membership", ["usable", "train"], "SELECT subject_id, t FROM usable WHERE subject_id IN (SELECT subject_id FROM train)")
def jn9(ctx):
    return restrict(ctx.usable, ctx.train).select("subject_id", "t")


@query("jn10_forecast_outcome", ["forecasts"], "SELECT subject_id, target, batch, dose FROM forecasts")
def jn10(ctx):
    return ctx.forecasts.select("subject_id", "target", "batch", "dose")


@query("jn11_landmark", ["prefix"],
       f"SELECT subject_id, t, {_SQL_LOG} FROM prefix p WHERE t = (SELECT max(q.t) FROM prefix q WHERE q.subject_id = p.subject_id AND q.t <= 5)")
def jn11(ctx):
    return landmark(ctx.prefix, ctx.spec).select("subject_id", "t", *_log_features())


@query("jn12_leave_one_out_cohorts", ["ranked_index"],
       f"SELECT h.arm AS held_out, count(*) AS n, {sql6('avg(r.y)')} AS mean_index FROM (VALUES ('a0'), ('a1'), ('a2'), ('a3')) AS h(arm) JOIN ranked_index r ON r.arm <> h.arm GROUP BY h.arm")
def jn12(ctx):
    others = F.filter(F.array(*[F.lit(a) for a in ctx.spec.arms]), lambda a: a != F.col("arm"))
    # arm totals first, so the replication is over a handful of rows
    totals = with_arm(ctx.index, ctx.outcomes).groupBy("arm").agg(_n().alias("n"), F.sum("mean_state_index").alias("s"))
    return totals.select(F.explode(others).alias("held_out"), "n", "s").groupBy("held_out").agg(
        F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n")).alias("mean_index")
    )


@query("jn13_scaler_applied", ["scaled"], "SELECT subject_id, t, " + ", ".join(f"{sql6(f'x{d}')} AS {f}" for d, f in enumerate(FEATURES)) + " FROM scaled")
def jn13(ctx):
    return scale_rows(ctx.prefix, ctx.scaler, ctx.spec).select("subject_id", "t", *[r6(f).alias(f) for f in FEATURES])


# --- aggregates -------------------------------------------------------------------------


@query("ag1_subject_metadata", ["metadata"], f"SELECT subject_id, arm, batch, clutch, plate, n_drops, {sql6('pressure')} AS pressure, dose, last_t, n_sessions FROM metadata")
def ag1(ctx):
    return norm.subject_metadata(ctx.lazy_sessions).withColumn("pressure", r6("pressure"))


_LOGGED_DOUBLES = ("session_minutes", "event_seconds", "mean_speed", "max_speed", "mean_bend", "max_bend", "mean_likelihood")


@query("ag2_event_sessions", ["logged"],
       "SELECT subject_id, t, n_events, n_abnormal, n_severe, n_whirl, n_convulsion, stage_max, tracking_qc_pass, " + ", ".join(f"{sql6(c)} AS {c}" for c in _LOGGED_DOUBLES) + " FROM logged")
def ag2(ctx):
    return norm.aggregate_events(ctx.raw.event_log).withColumns({c: r6(c) for c in _LOGGED_DOUBLES})


@query("ag3_max_stage", ["stages"], "SELECT * FROM stages")
def ag3(ctx):
    return norm.max_stage(ctx.raw.event_log)


@query("ag4_median", ["log"], f"SELECT {sql6('median(event_duration_s)')} AS median_seconds FROM log")
def ag4(ctx):
    from driftpanel.functions.ranks import exact_percentiles

    return exact_percentiles(ctx.raw.event_log, ["event_duration_s"], [0.5]).select(r6("value").alias("median_seconds"))


@query("ag5_abnormality", ["behavior"], "SELECT subject_id, t, abnormality + 0.0 AS abnormality FROM behavior")
def ag5(ctx):
    return norm.normalize_behavior(ctx.sessions, ctx.raw.event_log).select("subject_id", "t", r6("abnormality").alias("abnormality"))


@query("ag6_manifest", ["outcomes"],
       "SELECT arm, count(*) AS n_subjects, count(*) FILTER (WHERE target = 1) AS n_positive, count(*) FILTER (WHERE target = 0) AS n_negative, "
       "count(*) FILTER (WHERE target IS NULL) AS n_unresolved FROM outcomes GROUP BY GROUPING SETS ((), (arm))")
def ag6(ctx):
    return norm.cohort_manifest(ctx.lazy_outcomes)


@query("ag7_survival", ["outcomes"], f"SELECT arm, {sql6('avg(CAST(survived AS INTEGER))')} AS survival_rate FROM outcomes GROUP BY arm")
def ag7(ctx):
    return survival_by_arm(ctx.lazy_outcomes).select("arm", r6("survival_rate").alias("survival_rate"))


@query("ag8_dataset_summary", ["sessions", "outcomes", "prefix"],
       "SELECT (SELECT count(*) FROM outcomes) AS n_subjects, (SELECT count(*) FROM sessions) AS n_sessions, (SELECT count(*) FROM sessions WHERE qc_pass) AS n_qc_pass, "
       f"(SELECT {sql6('avg(CAST(qc_pass AS INTEGER))')} FROM sessions) AS qc_pass_rate, (SELECT count(*) FROM prefix) AS n_contiguous_sessions, (SELECT count(*) FROM prefix WHERE t = 4) AS n_subjects_with_baseline")
def ag8(ctx):
    return dataset_summary(ctx.sessions, ctx.outcomes, ctx.spec).withColumn("qc_pass_rate", r6("qc_pass_rate"))


@query("ag9_endpoint", ["endpoint"], "SELECT subject_id, target FROM endpoint")
def ag9(ctx):
    return norm.endpoint(ctx.lazy_sessions, ctx.raw.event_log, ctx.spec)


@query("ag10_robust_scaler", ["scaler"], "SELECT " + ", ".join(f"{sql6(f'c{d}')} AS center_{f}, {sql6(f's{d}')} AS scale_{f}" for d, f in enumerate(FEATURES)) + " FROM scaler")
def ag10(ctx):
    from driftpanel.operators.sequences import fit_scaler

    fitted = fit_scaler(restrict(ctx.prefix, ctx.train), ctx.spec)
    cells = []
    for d, f in enumerate(FEATURES):
        cells += [r6(F.get("center", F.lit(d))).alias(f"center_{f}"), r6(F.get("scale", F.lit(d))).alias(f"scale_{f}")]
    return fitted.select(*cells)


@query("ag11_covariates", ["covariates"],
       "SELECT subject_id, batch, clutch, " + ", ".join(f"{sql6(c)} AS {c}" for c in ("mean_hour", "mean_shift", "mean_noise")) + " FROM covariates", extra=_COVARIATES)
def ag11(ctx):
    return subject_covariates(ctx.usable).withColumns({c: r6(c) for c in ("mean_hour", "mean_shift", "mean_noise")})


@query("ag16_confusion", ["forecasts"],
       "SELECT tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, "
       f"{sql6('tp / greatest(1, tp + fn)')} AS sensitivity, {sql6('tn / greatest(1, tn + fp)')} AS specificity FROM (SELECT count(*) FILTER (WHERE risk >= 0.5 AND target = 1) AS tp, "
       "count(*) FILTER (WHERE risk < 0.5 AND target = 0) AS tn, count(*) FILTER (WHERE risk >= 0.5 AND target = 0) AS fp, count(*) FILTER (WHERE risk < 0.5 AND target = 1) AS fn FROM forecasts)")
def ag16(ctx):
    return stats.confusion(ctx.forecasts, "risk", "target").withColumns({c: r6(c) for c in ("sensitivity", "specificity")})


@query("ag17_brier", ["forecasts"], f"SELECT {sql6('avg((risk - target) * (risk - target))')} AS brier_score FROM forecasts")
def ag17(ctx):
    return stats.brier(ctx.forecasts, "risk", "target").select(r6("brier_score").alias("brier_score"))


@query("ag18_calibration", ["forecasts"],
       f"SELECT {sql6('avg(target)')} AS observed_positive_rate, {sql6('avg(risk)')} AS mean_risk, {sql6('max(risk)')} AS max_risk, "
       f"count(*) FILTER (WHERE risk >= 0.5) AS n_above_threshold, {sql6('median(risk)')} AS median_risk FROM forecasts")
def ag18(ctx):
    table = stats.calibration(ctx.forecasts, "risk", "target")
    return table.withColumns({c: r6(c) for c in ("observed_positive_rate", "mean_risk", "max_risk", "median_risk")})


@query("ag19_distinct", ["sessions", "outcomes"],
       "SELECT (SELECT count(*) FROM (SELECT DISTINCT subject_id, arm, t FROM sessions)) AS n_scaffold, (SELECT count(DISTINCT subject_id) FROM sessions) AS n_subjects, (SELECT count(DISTINCT target) FROM outcomes) AS n_classes")
def ag19(ctx):
    scaffold = norm.session_scaffold(ctx.sessions).agg(_n().alias("n_scaffold"))
    subjects = ctx.sessions.agg(F.count_distinct("subject_id").alias("n_subjects"))
    classes = ctx.outcomes.agg(F.count_distinct("target").alias("n_classes"))
    return with_constants(with_constants(scaffold, subjects), classes)


# --- set operations ---------------------------------------------------------------------


@query("se1_observed_union", ["observed"], "SELECT subject_id FROM observed")
def se1(ctx):
    return norm.observed_subjects(ctx.sessions, ctx.raw.event_log, ctx.spec)


@query("se2_frames_union", ["prefix", "assigned"], "SELECT a.split, count(*) AS n_sessions, count(DISTINCT p.subject_id) AS n_subjects FROM prefix p JOIN assigned a USING (subject_id) GROUP BY a.split")
def se2(ctx):
    train = restrict(ctx.prefix, ctx.train).withColumn("split", F.lit("train"))
    test = restrict(ctx.prefix, ctx.test).withColumn("split", F.lit("test"))
    return train.unionByName(test).groupBy("split").agg(_n().alias("n_sessions"), F.count_distinct("subject_id").alias("n_subjects"))


@query("se3_train_difference", ["outcomes", "test"], "SELECT subject_id FROM outcomes EXCEPT SELECT subject_id FROM test")
def se3(ctx):
    return ctx.outcomes.select("subject_id").join(by_key(ctx.test.select("subject_id")), "subject_id", "left_anti")


@query("se4_overlap", ["train", "test"], "SELECT count(*) AS n_overlap FROM (SELECT subject_id FROM train INTERSECT SELECT subject_id FROM test)")
def se4(ctx):
    return ctx.train.select("subject_id").intersect(ctx.test.select("subject_id")).agg(_n().alias("n_overlap"))
