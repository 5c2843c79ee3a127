"""The same operators over the larger order study: customers, order years, five arms, unknown targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpanel.functions.columns import r6
from driftpanel.operators import normalize as norm
from driftpanel.operators import ordering, quality, stats
from driftpanel.operators import states as st
from driftpanel.operators.hmm import infer
from driftpanel.operators.sequences import contiguous_prefix, fit_scaler, restrict
from driftpanel.operators.split import split_subjects
from driftpanel.plans.oracle import FEATURES, mid_rank, r6 as sql6
from driftpanel.plans.registry import query
from driftpanel.plans.statistic_queries import _auc
from driftpanel.sources.adapters import ORDER_SPEC

_RANK = "CASE c_mktsegment " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ORDER_SPEC.arms)) + " END"

# The raw tables of the order study; every later fragment is shared with the event study.
ORDERS = {
    "facts": (
        [],
        "SELECT o_custkey, o_orderdate, CAST(floor((year(o_orderdate) - 1995) / 3) AS INTEGER) + 4 AS t, l_linenumber, l_quantity, l_discount, l_returnflag, "
        "l_extendedprice * (1 - l_discount) / 1000 AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    ),
    "sessions": (
        ["facts"],
        "SELECT CAST(o_custkey AS VARCHAR) AS subject_id, c_mktsegment AS arm, CAST(o_custkey % 3 AS INTEGER) AS batch, 'c' || (o_custkey % 7) AS clutch, "
        f"'p' || (o_custkey % 11) AS plate, 3 AS baseline_t, t, {_RANK} AS n_drops, 90.0::DOUBLE * {_RANK} + t AS pressure, 100.0::DOUBLE * {_RANK} + o_custkey % 10 AS dose, "
        "0.05::DOUBLE AS noise, shift, shift <= 50 AS qc_pass, started_at, f_var, f_peak, f_rate, f_pow4 FROM ("
        "SELECT o_custkey, t, count(*) FILTER (WHERE l_discount > 0.08::DOUBLE) * 100.0::DOUBLE / count(*) AS shift, min(o_orderdate) AS started_at, "
        "var_pop(value) AS f_var, max(value) / (1 + avg(value)) AS f_peak, count(*) FILTER (WHERE l_quantity >= 45) / 10.0::DOUBLE AS f_rate, avg(power(value, 4)) AS f_pow4 "
        "FROM facts WHERE l_returnflag <> 'R' GROUP BY o_custkey, t) JOIN customer ON o_custkey = c_custkey",
    ),
    "log": (
        ["facts"],
        "SELECT CAST(o_custkey AS VARCHAR) AS subject_id, t, l_quantity >= 40 AND value >= 20 AS qualifies, "
        "CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS stage, "
        "CASE WHEN l_quantity >= 40 THEN 'convulsion_posture_loss' WHEN l_quantity >= 25 THEN 'whirlpool' ELSE 'swim' END AS behavior_class, "
        "300.0::DOUBLE AS session_duration_s, value AS event_duration_s, value / 10 AS mean_velocity, value / 5 AS peak_velocity, "
        "value / 4 AS rms_bend, value / 2 AS max_bend, 0.5::DOUBLE + l_discount AS likelihood, l_linenumber <> 7 AS tracking_qc_pass FROM facts WHERE l_returnflag = 'R'",
    ),
    "raw_outcomes": (
        [],
        "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject_id, CAST(o_custkey % 2 AS INTEGER) AS became_positive, CAST(NULL AS DOUBLE) AS first_event_hours "
        "FROM orders",
    ),
    "ranked_index": (
        ["state_index", "outcomes"],
        f"SELECT i.subject_id, i.mean_state_index AS y, {_RANK.replace('c_mktsegment', 'o.arm')} AS x, o.arm FROM state_index i JOIN outcomes o USING (subject_id)",
    ),
}


def orders(name, uses, sql, extra=None):
    return query(f"orders_{name}", uses, sql, kind="orders", extra={**ORDERS, **(extra or {})})


@orders("ag6_manifest", ["outcomes"],
        "SELECT arm, count(*) AS n_subjects, count(*) FILTER (WHERE target = 1) AS n_positive, count(*) FILTER (WHERE target = 0) AS n_negative, "
        "count(*) FILTER (WHERE target IS NULL) AS n_unresolved FROM outcomes GROUP BY GROUPING SETS ((), (arm))")
def manifest(ctx):
    return norm.cohort_manifest(ctx.lazy_outcomes)


@orders("ag9_endpoint", ["metadata", "endpoint"], "SELECT subject_id, target FROM metadata LEFT JOIN endpoint USING (subject_id)")
def endpoint(ctx):
    """Three-valued: many customers are not seen in the target year, and stay unknown."""
    return ctx.lazy_outcomes.select("subject_id", "target")


@orders("ag2_event_sessions", ["logged"], "SELECT subject_id, t, n_events, n_severe, stage_max, round(event_seconds, 8) AS event_seconds, round(max_speed, 8) AS max_speed FROM logged")
def event_sessions(ctx):
    table = norm.aggregate_events(ctx.raw.event_log)
    # prices have so many decimals that a sum can end in an exact half at six places
    rounded = [F.round(c, 8).alias(c) for c in ("event_seconds", "max_speed")]
    return table.select("subject_id", "t", "n_events", "n_severe", "stage_max", *rounded)


@orders("ag5_abnormality", ["behavior"], "SELECT subject_id, t, n_events, abnormality + 0.0 AS abnormality FROM behavior")
def abnormality(ctx):
    return norm.normalize_behavior(ctx.sessions, ctx.raw.event_log).select("subject_id", "t", "n_events", r6("abnormality").alias("abnormality"))


@orders("dq_panel", ["sessions", "outcomes", "behavior"],
        "SELECT 'period_outside_window' AS rule, count(*) FILTER (WHERE t NOT BETWEEN 4 AND 6) AS n_bad FROM sessions UNION ALL SELECT 'wrong_baseline_period', 0 UNION ALL SELECT 'unknown_arm', 0 UNION ALL SELECT 'feature_not_finite', 0 UNION ALL SELECT 'negative_feature', 0 "
        "UNION ALL SELECT 'negative_session_dose', 0 UNION ALL SELECT 'qc_flag_differs_from_rule', count(*) FILTER (WHERE (shift <= 50) <> qc_pass) FROM sessions UNION ALL SELECT 'duplicate_session', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM sessions GROUP BY subject_id, t) "
        "UNION ALL SELECT 'no_resolved_target', 0 UNION ALL SELECT 'target_mostly_unresolved', 0 UNION ALL SELECT 'target_has_one_class', 0 UNION ALL SELECT 'negative_outcome_dose', 0 "
        "UNION ALL SELECT 'session_without_outcome', count(*) FROM sessions WHERE subject_id NOT IN (SELECT subject_id FROM outcomes) UNION ALL SELECT 'behavior_without_outcome', count(*) FROM behavior WHERE subject_id NOT IN (SELECT subject_id FROM outcomes) "
        "UNION ALL SELECT 'repeated_outcome', count(*) FROM (SELECT subject_id FROM outcomes GROUP BY subject_id HAVING count(*) > 1)")
def panel_rules(ctx):
    return quality.panel_violations(ctx.sessions, ctx.outcomes, ctx.behavior, ctx.spec)


@orders("wn1_prefix", ["prefix"], "SELECT subject_id, t, pos FROM prefix")
def prefix(ctx):
    return contiguous_prefix(ctx.usable, ctx.spec).select("subject_id", "t", (F.col("t") - ctx.spec.t0).alias("pos"))


@orders("wn6_split", ["assigned"], "SELECT subject_id, arm, target, split FROM assigned")
def split(ctx):
    """Includes the strata of unknown targets."""
    return split_subjects(ctx.outcomes)


@orders("ag10_scaler", ["scaler"], "SELECT " + ", ".join(f"{sql6(f'c{d}')} AS center_{f}, {sql6(f's{d}')} AS scale_{f}" for d, f in enumerate(FEATURES)) + " FROM scaler")
def scaler(ctx):
    fitted = fit_scaler(restrict(ctx.prefix, ctx.train), ctx.spec)
    cells = []
    for d, f in enumerate(FEATURES):
        cells += [r6(F.get("center", F.lit(d))).alias(f"center_{f}"), r6(F.get("scale", F.lit(d))).alias(f"scale_{f}")]
    return fitted.select(*cells)


@orders("hm7_log_likelihood", ["loglik"], f"SELECT subject_id, n, {sql6('loglik')} AS loglik FROM loglik")
def log_likelihood(ctx):
    return infer(ctx.sequences, ctx.model).select("subject_id", F.size("xs").cast("long").alias("n"), r6("loglik").alias("loglik"))


@orders("hm8_viterbi", ["decoded"], "SELECT subject_id, pos, k AS state FROM decoded")
def viterbi(ctx):
    return infer(ctx.sequences.select("subject_id", "xs"), ctx.model).select("subject_id", F.posexplode("path").alias("pos", "state"))


@orders("hm13_forecast", ["forecasts"], f"SELECT subject_id, arm, last_t, steps, {sql6('current_risk')} AS current_risk, {sql6('risk')} AS risk, target, batch, dose FROM forecasts")
def forecasts(ctx):
    return ctx.forecasts.withColumns({c: r6(c) for c in ("current_risk", "risk")})


@orders("ag12_occupancy", ["test_scored"],
        f"SELECT arm, t, count(*) AS n_sessions, {sql6('avg(expected_state)')} AS mean_expected_state, " + ", ".join(f"{sql6(f'avg((state = {k})::INTEGER)')} AS fraction_state_{k}" for k in range(3)) + " FROM test_scored GROUP BY arm, t")
def occupancy(ctx):
    table = st.occupancy(ctx.scored, ctx.model.n_states)
    return table.withColumns({c: r6(c) for c in table.columns if c.startswith(("mean_", "fraction_"))})


@orders("st1_roc_auc", ["forecasts"],
        f"SELECT (SELECT count(*) FROM forecasts WHERE target = 1) AS n_positive, (SELECT count(*) FROM forecasts WHERE target = 0) AS n_negative, {sql6(f'({_auc('risk', 'forecasts')})')} AS roc_auc")
def roc_auc(ctx):
    return stats.roc_auc(ctx.forecasts, "risk", "target").withColumn("roc_auc", r6("roc_auc"))


@orders("st4_spearman", ["ranked_index"], f"SELECT count(*) AS n, {sql6('corr(rx, ry)')} AS rho FROM (SELECT {mid_rank('x')} AS rx, {mid_rank('y')} AS ry FROM ranked_index)")
def order_rho(ctx):
    joined = ordering.with_arm(ctx.index, ctx.outcomes)
    return stats.spearman_ordinal(joined, "mean_state_index", "arm", ctx.spec.arms).withColumn("rho", r6("rho"))


@orders("st10_behavior_rho", ["merged_behavior"], f"SELECT count(*) AS n, {sql6('corr(rx, ry)')} AS rho FROM (SELECT {mid_rank('risk')} AS rx, {mid_rank('abnormality')} AS ry FROM merged_behavior)")
def behavior_rho(ctx):
    return stats.spearman(ctx.merged_behavior, "risk", "abnormality").withColumn("rho", r6("rho"))
