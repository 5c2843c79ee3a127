"""Queries over splits, windows, sequences, and hidden-state inference and fitting."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Window, functions as F

from driftpanel.functions.columns import arm_rank, clip, expected_index, hour_of_day, permute, propagate, r6, stratum
from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.ranks import average_ranks, exact_percentiles, with_constants
from driftpanel.operators import hmm, stats
from driftpanel.operators import states as st
from driftpanel.operators.hmm import FitRequest, fit_many, infer, prepare
from driftpanel.operators.ordering import control_only_refit
from driftpanel.operators.partial import one_hot
from driftpanel.operators.selection import (
    best_restart,
    best_state_count,
    bic,
    fold_summary,
    parameter_count,
    select_state_count,
)
from driftpanel.operators.sequences import build_sequences, contiguous_prefix, fit_scaler, log_rows, restrict, scale_rows
from driftpanel.operators.split import assign_folds, rebalance_arms, split_subjects, stratified_pick
from driftpanel.operators.stats import threshold_counts
from driftpanel.plans.context import FIXED_MODEL, FIXED_TWO_STATE
from driftpanel.plans.oracle import FEATURES, centre_tables, mid_rank, r6 as sql6
from driftpanel.plans.registry import query
from driftpanel.spec import study_options


def _n():
    return F.count(F.lit(1))


_K = FIXED_MODEL.n_states


# --- windows ----------------------------------------------------------------------------


@query("wn1_prefix", ["prefix"], "SELECT subject_id, t, pos FROM prefix")
def wn1(ctx):
    return contiguous_prefix(ctx.usable, ctx.spec).select("subject_id", "t", (F.col("t") - ctx.spec.t0).alias("pos"))


_CHANGES = {
    "changes": (
        ["test_scored"],
        "SELECT * FROM (SELECT subject_id, arm, t, state - lag(state) OVER (PARTITION BY subject_id ORDER BY t) AS change FROM test_scored) WHERE change IS NOT NULL",
    )
}


@query("wn2_state_changes", ["changes"], "SELECT subject_id, t, change FROM changes", extra=_CHANGES)
def wn2(ctx):
    return st.state_changes(ctx.scored).select("subject_id", "t", "change")


@query("wn3_average_ranks", ["ranked_index"], f"SELECT subject_id, {mid_rank('round(y, 9)')} AS rank_index, {mid_rank('x')} AS rank_arm FROM ranked_index")
def wn3(ctx):
    joined = ctx.index.join(by_key(ctx.outcomes.select("subject_id", "arm")), "subject_id").select(
        "subject_id", F.round("mean_state_index", 9).alias("y"), arm_rank(ctx.spec).alias("x")
    )
    half = cut_lineage(average_ranks(cut_lineage(joined), "y", "rank_index"))
    return average_ranks(half, "x", "rank_arm").select("subject_id", "rank_index", "rank_arm")


@query("wn4_position", ["test_scored"], "SELECT subject_id, t, pos AS position FROM test_scored")
def wn4(ctx):
    return ctx.scored.select("subject_id", "t", "position")


@query("wn5_stratified_pick", ["picked"], "SELECT subject_id, stratum, is_test FROM picked")
def wn5(ctx):
    return stratified_pick(ctx.outcomes, 0.30, 42).select("subject_id", "stratum", "is_test")


@query("wn6_rebalanced_split", ["assigned"], "SELECT subject_id, arm, target, split FROM assigned")
def wn6(ctx):
    return split_subjects(ctx.outcomes, 0.30, 42)


@query("wn7_folds", ["folds"], "SELECT subject_id, arm, fold FROM folds")
def wn7(ctx):
    return assign_folds(ctx.assignments, 3)


@query("wn8_threshold_counts", ["forecasts"],
       f"SELECT {sql6('risk')} AS threshold, CAST(sum(count(*) FILTER (WHERE target = 1)) OVER (ORDER BY risk DESC) AS BIGINT) AS tp, "
       "CAST(sum(count(*) FILTER (WHERE target = 0)) OVER (ORDER BY risk DESC) AS BIGINT) AS fp FROM forecasts GROUP BY risk")
def wn8(ctx):
    return threshold_counts(ctx.forecasts, "risk", "target").select(r6("threshold").alias("threshold"), "tp", "fp")


# --- sorts and selections ---------------------------------------------------------------


@query("so1_row_order", ["sessions"], "SELECT subject_id, t, row_number() OVER (PARTITION BY subject_id ORDER BY t) AS place FROM sessions ORDER BY subject_id, t")
def so1(ctx):
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy("t")).cast("long")
    return ctx.sessions.select("subject_id", "t", place.alias("place")).orderBy("subject_id", "t")


@query("so2_arm_order", ["test_scored"], "SELECT arm, t, count(*) AS n_sessions FROM test_scored GROUP BY arm, t ORDER BY arm, t")
def so2(ctx):
    return st.by_arm_and_period(ctx.scored.groupBy("arm", "t").agg(_n().alias("n_sessions")), ctx.spec)


def _two_models(ctx):
    """Log likelihood and session count of the two fixed models: ``n_states, loglik, n_sessions``."""
    parts = []
    for model in (FIXED_TWO_STATE, FIXED_MODEL):
        scores = infer(ctx.sequences.select("subject_id", "xs"), model)
        parts.append(scores.agg(F.sum("loglik").alias("loglik"), F.sum(F.size("xs")).alias("n_sessions")).withColumn("n_states", F.lit(model.n_states)))
    return parts[0].unionByName(parts[1])


def _with_bic(table):
    table = table.withColumn("n_parameters", parameter_count(F.col("n_states"), len(FEATURES)))
    return table.withColumn("bic", bic(F.col("loglik"), F.col("n_parameters"), F.col("n_sessions")))


_BIC = {
    "bics": (
        ["loglik", "two_loglik"],
        "SELECT n_states, loglik, n_sessions, p AS n_parameters, -2 * loglik + p * ln(n_sessions) AS bic FROM ("
        "SELECT 3 AS n_states, sum(loglik) AS loglik, (SELECT count(*) FROM scaled) AS n_sessions, 2 + 6 + 24 AS p FROM loglik "
        "UNION ALL SELECT 2, sum(loglik), (SELECT count(*) FROM scaled), 1 + 2 + 16 FROM two_loglik)",
    )
}


@query("so3_best_state_count", ["bics"], "SELECT arg_min(n_states, bic) AS n_states FROM bics", extra=_BIC)
def so3(ctx):
    return best_state_count(_with_bic(_two_models(ctx)))


@query("so4_best_restart", ["loglik", "two_loglik"],
       f"SELECT 3 AS n_states, CASE WHEN a >= b THEN 0 ELSE 1 END AS restart, {sql6('greatest(a, b)')} AS loglik FROM (SELECT (SELECT sum(loglik) FROM loglik) AS a, (SELECT sum(loglik) FROM two_loglik) AS b)")
def so4(ctx):
    """The two fixed models compete as two restarts of one fit."""
    fits = _two_models(ctx).select(F.lit(3).alias("n_states"), (F.lit(3) - F.col("n_states")).alias("restart"), "loglik")
    return best_restart(fits).withColumn("loglik", r6("loglik"))


_STATE_MEANS = {
    "state_means": (
        ["scaled", "decoded"],
        "SELECT d.k AS state, " + ", ".join(f"avg(s.x{d}) AS m{d}" for d in range(4)) + " FROM scaled s JOIN decoded d ON s.subject_id = d.subject_id AND s.pos = d.pos GROUP BY d.k",
    )
}


def _raw_state_means(ctx):
    """Mean scaled feature of each raw decoded state: ``state, feature, mean``."""
    inferred = infer(ctx.sequences.select("subject_id", "xs"), ctx.model)
    rows = inferred.select(F.inline(F.arrays_zip(F.col("path").alias("state"), F.col("xs").alias("x"))))
    long = rows.select("state", F.posexplode("x").alias("d", "v"))
    names = F.array(*[F.lit(f) for f in FEATURES])
    return long.groupBy("state", "d").agg(F.avg("v").alias("mean")).select("state", F.get(names, F.col("d")).alias("feature"), "mean")


@query("so5_severity_order", ["state_means"],
       f"SELECT state, {sql6('(m0 + m1 + m2 + m3) / 4')} AS score, CAST(row_number() OVER (ORDER BY (m0 + m1 + m2 + m3) / 4) - 1 AS INTEGER) AS severity FROM state_means", extra=_STATE_MEANS)
def so5(ctx):
    return st.severity_table(_raw_state_means(ctx), ctx.spec.features).withColumn("score", r6("score"))


# --- scalar and array functions ---------------------------------------------------------


@query("sc1_log1p", ["sessions"], "SELECT subject_id, t, " + ", ".join(f"{sql6(f'ln(1 + {f})')} AS {f}" for f in FEATURES) + " FROM sessions")
def sc1(ctx):
    return log_rows(ctx.sessions, ctx.spec).select("subject_id", "t", *[r6(f).alias(f) for f in FEATURES])


@query("sc2_standardise", ["scaled"], "SELECT arm, t, " + ", ".join(f"{sql6(f'avg(x{d})')} AS {f}" for d, f in enumerate(FEATURES)) + " FROM scaled GROUP BY arm, t")
def sc2(ctx):
    rows = scale_rows(ctx.prefix, ctx.scaler, ctx.spec)
    return rows.groupBy("arm", "t").agg(*[r6(F.avg(f)).alias(f) for f in FEATURES])


@query("sc3_clip", ["scaled"], f"SELECT subject_id, t, {sql6('greatest(-1::DOUBLE, least(1::DOUBLE, x0))')} AS clipped FROM scaled")
def sc3(ctx):
    return scale_rows(ctx.prefix, ctx.scaler, ctx.spec).select("subject_id", "t", r6(clip(F.col("f_var"), -1.0, 1.0)).alias("clipped"))


@query("sc4_round", ["behavior"], "SELECT subject_id, t, round(rest_fraction, 6) + 0.0 AS rest_fraction FROM behavior")
def sc4(ctx):
    return ctx.behavior.select("subject_id", "t", (F.round("rest_fraction", 6) + 0.0).alias("rest_fraction"))


@query("sc5_concat", ["outcomes"], "SELECT subject_id, arm || '__' || coalesce(CAST(target AS VARCHAR), 'missing') AS stratum FROM outcomes")
def sc5(ctx):
    return ctx.outcomes.select("subject_id", stratum().alias("stratum"))


@query("sc6_time_parts", ["sessions"], "SELECT subject_id, t, CAST(hour(started_at) AS INTEGER) AS h, CAST(minute(started_at) AS INTEGER) AS m FROM sessions")
def sc6(ctx):
    ts = F.to_timestamp("started_at")
    return ctx.sessions.select("subject_id", "t", F.hour(ts).alias("h"), F.minute(ts).alias("m"))


@query("sc7_one_hot", ["outcomes"], "SELECT subject_id, (arm = 'a1')::INTEGER::DOUBLE AS is_a1, (arm = 'a2')::INTEGER::DOUBLE AS is_a2, (arm = 'a3')::INTEGER::DOUBLE AS is_a3 FROM outcomes")
def sc7(ctx):
    flags = one_hot("arm", ctx.spec.arms)
    return ctx.outcomes.select("subject_id", *[c.alias(f"is_{a}") for c, a in zip(flags, ctx.spec.arms[1:])])


@query("sc8_log_sum", ["emit"], f"SELECT subject_id, pos, {sql6('max(logb) + ln(sum(exp(logb - peak)))')} AS log_sum FROM (SELECT *, max(logb) OVER (PARTITION BY subject_id, pos) AS peak FROM emit) GROUP BY subject_id, pos")
def sc8(ctx):
    """Log of summed state densities, as column arithmetic with the maximum taken out."""
    density = _density_columns(ctx.sequences)
    peak = F.greatest(*[F.col(f"logb_{k}") for k in range(_K)])
    total = sum((F.exp(F.col(f"logb_{k}") - peak) for k in range(_K)), F.lit(0.0))
    return density.select("subject_id", "pos", r6(peak + F.log(total)).alias("log_sum"))


def _density_columns(sequences):
    """Log density of each session under each fixed state, inside generated code."""
    rows = sequences.select("subject_id", F.posexplode("xs").alias("pos", "x"))
    columns = []
    for k in range(_K):
        terms = F.lit(len(FEATURES) * hmm.LOG_2PI + float(np.log(FIXED_MODEL.covars[k]).sum()))
        for d in range(len(FEATURES)):
            delta = F.get("x", F.lit(d)) - float(FIXED_MODEL.means[k, d])
            terms = terms + delta * delta / float(FIXED_MODEL.covars[k, d])
        columns.append((-0.5 * terms).alias(f"logb_{k}"))
    return rows.select("subject_id", "pos", *columns)


_PROPAGATED = "SELECT subject_id, " + ", ".join(f"{sql6(f'sum(p) FILTER (WHERE severity = {k})')} AS p_{k}" for k in range(_K))


@query("sc9_matrix_power", ["carried", "test"], f"{_PROPAGATED} FROM carried WHERE subject_id IN (SELECT subject_id FROM test) GROUP BY subject_id")
def sc9(ctx):
    matrix = st.matrix_literal(ctx.model.trans[np.ix_(ctx.order, ctx.order)])
    last = ctx.scored.where(F.col("t") <= ctx.spec.t_cutoff).groupBy("subject_id").agg(F.max_by("p_state", "t").alias("p"), F.max("t").alias("t"))
    carried = propagate(F.col("p"), matrix, F.lit(ctx.spec.t_target) - F.col("t"), _K)
    return last.select("subject_id", carried.alias("q")).select("subject_id", *[r6(F.get("q", F.lit(k))).alias(f"p_{k}") for k in range(_K)])


@query("sc10_expected_state", ["test_scored"], f"SELECT subject_id, t, {sql6('expected_state')} AS expected_state FROM test_scored")
def sc10(ctx):
    return ctx.scored.select("subject_id", "t", r6(expected_index(F.col("p_state"))).alias("expected_state"))


@query("sc11_permute", ["posterior"], "SELECT subject_id, pos, " + ", ".join(f"{sql6(f'sum(p) FILTER (WHERE severity = {k})')} AS p_{k}" for k in range(_K)) + " FROM posterior GROUP BY subject_id, pos")
def sc11(ctx):
    raw = infer(ctx.sequences.select("subject_id", "xs"), ctx.model)
    order = F.array(*[F.lit(int(o)) for o in ctx.order])
    rows = raw.select("subject_id", F.posexplode("posterior").alias("pos", "raw")).withColumn("p", permute(F.col("raw"), order))
    return rows.select("subject_id", "pos", *[r6(F.get("p", F.lit(k))).alias(f"p_{k}") for k in range(_K)])


# --- inference --------------------------------------------------------------------------


@query("hm1_sequences", ["scaled"],
       "SELECT subject_id, count(*) AS length, min(t) AS first_t, max(t) AS last_t, " + ", ".join(f"{sql6(f'arg_max(x{d}, t)')} AS last_{f}" for d, f in enumerate(FEATURES)) + " FROM scaled GROUP BY subject_id")
def hm1(ctx):
    built = build_sequences(scale_rows(ctx.prefix, ctx.scaler, ctx.spec), ctx.spec)
    last = F.element_at("xs", -1)
    return built.select(
        "subject_id", F.size("xs").cast("long").alias("length"), F.get("ts", F.lit(0)).alias("first_t"), F.element_at("ts", -1).alias("last_t"),
        *[r6(F.get(last, F.lit(d))).alias(f"last_{f}") for d, f in enumerate(FEATURES)],
    )


@query("hm2_log_density", ["emit"], "SELECT subject_id, pos, " + ", ".join(f"{sql6(f'sum(logb) FILTER (WHERE k = {k})')} AS logb_{k}" for k in range(_K)) + " FROM emit GROUP BY subject_id, pos")
def hm2(ctx):
    return _density_columns(ctx.sequences).withColumns({f"logb_{k}": r6(f"logb_{k}") for k in range(_K)})


def _fit_table(ctx):
    train = restrict(ctx.prefix, ctx.train).join(by_key(ctx.folds.select("subject_id", "fold")), "subject_id")
    built = build_sequences(log_rows(train, ctx.spec), ctx.spec, carry=("fold",))
    return prepare(built.withColumn("fold", F.get("fold", F.lit(0))), fold="fold")


def _request(ctx, **changes):
    s = ctx.scaler.first()
    return FitRequest(replace(study_options(3, 42, 3), **changes), tuple(s.center), tuple(s.scale))


@query("hm3_initial_centres", ["centres"],
       " UNION ALL ".join(f"SELECT CAST(restart AS INTEGER) AS restart, CAST(k AS INTEGER) AS state, '{f}' AS feature, {sql6(f'x{d}')} AS mean FROM centres" for d, f in enumerate(FEATURES)),
       extra=centre_tables(42, 3, 3, hmm.LLOYD_STEPS))
def hm3(ctx):
    """Seeded centres after the Lloyd steps, per restart."""
    table = _fit_table(ctx)
    runs = [hmm._Run(i, _request(ctx), i) for i in range(3)]
    hmm._initialise(table, runs)
    rows = [(r.restart, k, f, float(r.model.means[k, d])) for r in runs for k in range(3) for d, f in enumerate(FEATURES)]
    return ctx.spark.createDataFrame(rows, "restart int, state int, feature string, mean double").withColumn("mean", r6("mean"))


_WEIGHTED_PATHS = {
    "train_paths": (
        ["paths", "train"],
        "SELECT *, exp(score - max(score) OVER (PARTITION BY subject_id)) / sum(exp(score - top)) OVER (PARTITION BY subject_id) AS w, "
        "ln(sum(exp(score - top)) OVER (PARTITION BY subject_id)) + top AS ll FROM (SELECT *, max(score) OVER (PARTITION BY subject_id) AS top FROM paths) WHERE subject_id IN (SELECT subject_id FROM train)",
    ),
    "gammas": (
        ["train_paths"],
        "SELECT subject_id, 0 AS pos, k0 AS k, sum(w) AS g FROM train_paths GROUP BY subject_id, k0 UNION ALL SELECT subject_id, 1, k1, sum(w) FROM train_paths WHERE k1 IS NOT NULL GROUP BY subject_id, k1 "
        "UNION ALL SELECT subject_id, 2, k2, sum(w) FROM train_paths WHERE k2 IS NOT NULL GROUP BY subject_id, k2",
    ),
    "start_sums": (["gammas"], "SELECT k, sum(g) AS v FROM gammas WHERE pos = 0 GROUP BY k"),
    "step_sums": (
        ["train_paths"],
        "SELECT i, j, sum(w) AS v FROM (SELECT k0 AS i, k1 AS j, w FROM train_paths WHERE k1 IS NOT NULL UNION ALL SELECT k1, k2, w FROM train_paths WHERE k2 IS NOT NULL) GROUP BY i, j",
    ),
    "moment_sums": (
        ["gammas", "scaled"],
        "SELECT g.k, d.d, sum(g.g) AS w, sum(g.g * d.x) AS s, sum(g.g * d.x * d.x) AS ss FROM gammas g JOIN ("
        + " UNION ALL ".join(f"SELECT subject_id, pos, {d} AS d, x{d} AS x FROM scaled" for d in range(4))
        + ") d ON g.subject_id = d.subject_id AND g.pos = d.pos GROUP BY g.k, d.d",
    ),
}


@query("hm4_expectation", ["start_sums", "step_sums", "moment_sums", "train_paths"],
       f"SELECT 'loglik' AS stat, 0 AS i, 0 AS j, {sql6('sum(ll)')} AS value FROM (SELECT DISTINCT subject_id, ll FROM train_paths) "
       f"UNION ALL SELECT 'start', k, 0, {sql6('v')} FROM start_sums UNION ALL SELECT 'step', i, j, {sql6('v')} FROM step_sums "
       f"UNION ALL SELECT 'weight', k, 0, {sql6('w')} FROM moment_sums WHERE d = 0 UNION ALL SELECT 'sum', k, d, {sql6('s')} FROM moment_sums", extra=_WEIGHTED_PATHS)
def hm4(ctx):
    """Summed responsibilities of one pass for the fixed model over the train subjects."""
    run = hmm._Run(0, _request(ctx), 0, model=FIXED_MODEL)
    stats = hmm._pass(_fit_table(ctx), [run], hmm._expect)[0]
    d = len(FEATURES)
    ll, start, trans, weight, first, _ = np.split(stats, np.cumsum([1, _K, _K * _K, _K, _K * d]))
    first = first.reshape(_K, d) + weight[:, None] * FIXED_MODEL.means
    rows = [("loglik", 0, 0, float(ll[0]))]
    for k in range(_K):
        rows += [("start", k, 0, float(start[k])), ("weight", k, 0, float(weight[k]))]
        rows += [("step", k, j, float(trans[k * _K + j])) for j in range(_K)]
        rows += [("sum", k, j, float(first[k, j])) for j in range(d)]
    table = ctx.spark.createDataFrame(rows, "stat string, i int, j int, value double")
    return table.withColumn("value", r6("value"))


@query("hm5_sequence_checks", ["scaled"],
       "SELECT 0::BIGINT AS n_not_finite, 0::BIGINT AS n_empty, 4 AS min_width, 4 AS max_width, count(*) AS n_observations FROM scaled")
def hm5(ctx):
    return hmm.check_sequences(ctx.sequences)


@query("hm6_em_update", ["start_sums", "step_sums", "moment_sums", "pooled"],
       f"SELECT 'start' AS parameter, k AS i, 0 AS j, {sql6('(v + 0.1) / (SELECT sum(v + 0.1) FROM start_sums)')} AS value FROM start_sums "
       f"UNION ALL SELECT 'transition', i, j, {sql6('(v + 0.25) / sum(v + 0.25) OVER (PARTITION BY i)')} FROM step_sums "
       f"UNION ALL SELECT 'mean', k, d, {sql6('s / w')} FROM moment_sums "
       f"UNION ALL SELECT 'variance', k, d, {sql6('greatest(0.001::DOUBLE, (greatest(0::DOUBLE, ss - s * s / w) + 0.05 * greatest(0.001::DOUBLE, (SELECT var_pop(p.x) FROM pooled p WHERE p.d = m.d))) / (w + 0.05))')} FROM moment_sums m",
       extra={
           **_WEIGHTED_PATHS,
           "pooled": (
               ["scaled", "train"],
               " UNION ALL ".join(f"SELECT {d} AS d, x{d} AS x FROM scaled WHERE subject_id IN (SELECT subject_id FROM train)" for d in range(4)),
           ),
       })
def hm6(ctx):
    """Parameters after one full update from the fixed model: pseudocounts, shrunken floored variances."""
    table = _fit_table(ctx)
    run = hmm._Run(0, _request(ctx), 0, model=FIXED_MODEL)
    n, *rest = hmm._pass(table, [run], hmm._moments)[0]
    rest = np.array(rest)
    mean, square = np.split(rest / n, 2)
    run.pooled = np.maximum(square - mean * mean, run.request.options.min_covar)
    run.model = hmm.HmmModel(FIXED_MODEL.start, FIXED_MODEL.trans, FIXED_MODEL.means, FIXED_MODEL.covars)
    hmm._update(run, hmm._pass(table, [run], hmm._expect)[0])
    return _parameter_rows(ctx, run.model)


def _parameter_rows(ctx, model):
    k, d = model.means.shape
    rows = [("start", i, 0, float(model.start[i])) for i in range(k)]
    rows += [("transition", i, j, float(model.trans[i, j])) for i in range(k) for j in range(k)]
    rows += [("mean", i, j, float(model.means[i, j])) for i in range(k) for j in range(d)]
    rows += [("variance", i, j, float(model.covars[i, j])) for i in range(k) for j in range(d)]
    table = ctx.spark.createDataFrame(rows, "parameter string, i int, j int, value double")
    return table.withColumn("value", r6("value"))


@query("hm6_fit")
def hm6_fit(ctx):
    """Parameters of a fit with three restarts over the train subjects."""
    return _parameter_rows(ctx, fit_many(_fit_table(ctx), [_request(ctx)])[0])


@query("hm7_log_likelihood", ["loglik"], f"SELECT subject_id, {sql6('loglik')} AS loglik FROM loglik")
def hm7(ctx):
    return infer(ctx.sequences, ctx.model).select("subject_id", r6("loglik").alias("loglik"))


@query("hm8_viterbi", ["decoded"], "SELECT subject_id, pos, k AS state FROM decoded")
def hm8(ctx):
    return infer(ctx.sequences.select("subject_id", "xs"), ctx.model).select("subject_id", F.posexplode("path").alias("pos", "state"))


@query("hm9_filter", ["posterior"], f"SELECT subject_id, pos, k AS state, {sql6('p')} AS p FROM posterior")
def hm9(ctx):
    rows = infer(ctx.sequences.select("subject_id", "xs"), ctx.model).select("subject_id", F.posexplode("posterior").alias("pos", "row"))
    return rows.select("subject_id", "pos", F.posexplode("row").alias("state", "p")).withColumn("p", r6("p"))


@query("hm10_select_state_count")
def hm10(ctx):
    """BIC and cross-validated likelihood of the candidate state counts."""
    return select_state_count(ctx.usable, ctx.folds, ctx.spec).table


_SCORED = "subject_id, arm, t, state AS predicted_state, " + ", ".join([f"{sql6('expected_state')} AS expected_state", *[f"{sql6(f'p{k}')} AS p_state_{k}" for k in range(_K)]])


@query("hm11_score_sessions", ["test_scored"], f"SELECT {_SCORED}, pressure, dose FROM test_scored")
def hm11(ctx):
    scored = st.score_sessions(st.decode(restrict(ctx.sequences, ctx.test), ctx.model, ctx.order))
    return scored.select(
        "subject_id", "arm", "t", F.col("state").alias("predicted_state"), r6("expected_state").alias("expected_state"),
        *[r6(c).alias(f"p_state_{k}") for k, c in enumerate(st.state_columns(_K))], "pressure", "dose",
    )


@query("hm12_propagate", ["carried", "test"], f"{_PROPAGATED} FROM carried WHERE subject_id NOT IN (SELECT subject_id FROM test) GROUP BY subject_id")
def hm12(ctx):
    matrix = st.matrix_literal(ctx.model.trans[np.ix_(ctx.order, ctx.order)])
    early = st.model_sequences(restrict(ctx.usable, ctx.train), ctx.scaler, ctx.spec, ctx.spec.t_cutoff)
    last = infer(early, ctx.model, order=ctx.order).select("subject_id", F.element_at("posterior", -1).alias("p"), F.element_at("ts", -1).alias("t"))
    carried = propagate(F.col("p"), matrix, F.lit(ctx.spec.t_target) - F.col("t"), _K)
    return last.select("subject_id", carried.alias("q")).select("subject_id", *[r6(F.get("q", F.lit(k))).alias(f"p_{k}") for k in range(_K)])


@query("hm13_forecast", ["forecasts"], f"SELECT subject_id, arm, last_t, steps, {sql6('current_risk')} AS current_risk, {sql6('risk')} AS risk, target, batch, dose FROM forecasts")
def hm13(ctx):
    decoded = st.decode(restrict(ctx.sequences, ctx.test), ctx.model, ctx.order)
    table = st.forecast(decoded, ctx.outcomes, ctx.model, ctx.order, ctx.spec)
    return table.withColumns({c: r6(c) for c in ("current_risk", "risk")})


@query("hm14_state_index", ["state_index"], f"SELECT subject_id, {sql6('mean_state_index')} AS mean_state_index, n_sessions FROM state_index")
def hm14(ctx):
    return st.state_index(st.decode(ctx.sequences, ctx.model, ctx.order)).withColumn("mean_state_index", r6("mean_state_index"))


@query("hm15_ordered_emission", ["state_means", "states"],
       "SELECT m.severity AS state, " + ", ".join(f"{sql6(f's.m{d}')} AS {f}" for d, f in enumerate(FEATURES)) + " FROM state_means s JOIN states m ON s.state = m.k", extra=_STATE_MEANS)
def hm15(ctx):
    """Emission means in severity order, re-estimated from the decoded sessions."""
    rank = np.argsort(ctx.order)
    severity = F.get(F.array(*[F.lit(int(r)) for r in rank]), F.col("state")).alias("state")
    cells = [F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f) for f in FEATURES]
    return _raw_state_means(ctx).select(severity, "feature", "mean").groupBy("state").agg(*cells).withColumns({f: r6(f) for f in FEATURES})


@query("hm15_ordered_transitions", ["decoded"],
       f"SELECT a.severity AS from_state, b.severity AS to_state, {sql6('count(*) / sum(count(*)) OVER (PARTITION BY a.severity)')} AS p FROM decoded a JOIN decoded b ON a.subject_id = b.subject_id AND b.pos = a.pos + 1 GROUP BY a.severity, b.severity")
def hm15_transitions(ctx):
    """Observed transition shares between severity states."""
    path = infer(ctx.sequences.select("subject_id", "xs"), ctx.model, order=ctx.order)
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))
    steps = path.select(F.inline(pairs)).groupBy(F.col("a").alias("from_state"), F.col("b").alias("to_state")).agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy("from_state"))
    return steps.select("from_state", "to_state", r6(F.col("n") / total).alias("p"))


_ORDERED = {
    **_WEIGHTED_PATHS,
    "em_means": (["moment_sums"], "SELECT k, d, s / w AS v FROM moment_sums"),
    "em_order": (["em_means"], "SELECT k, row_number() OVER (ORDER BY avg(v), k) - 1 AS severity FROM em_means GROUP BY k"),
    "em_steps": (
        ["step_sums", "em_order"],
        "SELECT a.severity AS i, b.severity AS j, (v + 0.25) / sum(v + 0.25) OVER (PARTITION BY s.i) AS p FROM step_sums s JOIN em_order a ON s.i = a.k JOIN em_order b ON s.j = b.k",
    ),
}


def _updated_tables(ctx):
    """Parameter tables of the fixed model after one update on the train subjects, in severity order."""
    run = hmm._Run(0, _request(ctx), 0, model=hmm.HmmModel(FIXED_MODEL.start, FIXED_MODEL.trans, FIXED_MODEL.means, FIXED_MODEL.covars))
    run.pooled = np.ones(len(FEATURES))
    hmm._update(run, hmm._pass(_fit_table(ctx), [run], hmm._expect)[0])
    return st.parameter_tables(ctx.sequences, run.model, st.severity_order(run.model, ctx.spec.features), ctx.spec)


@query("hm15_parameter_tables", ["start_sums", "em_steps", "em_means", "em_order"],
       f"SELECT 'start' AS parameter, CAST(severity AS INTEGER) AS state, 'state' AS target, {sql6('(v + 0.1) / (SELECT sum(v + 0.1) FROM start_sums)')} AS value FROM start_sums JOIN em_order USING (k) "
       f"UNION ALL SELECT 'transition', CAST(i AS INTEGER), CAST(j AS VARCHAR), {sql6('p')} FROM em_steps "
       "UNION ALL " + " UNION ALL ".join(f"SELECT 'emission', CAST(severity AS INTEGER), '{f}', {sql6('v')} FROM em_means JOIN em_order USING (k) WHERE d = {d}" for d, f in enumerate(FEATURES)),
       extra=_ORDERED)
def hm15_parameters(ctx):
    """Start, transition, and emission tables in severity order, from an updated model."""
    tables = _updated_tables(ctx)
    start = tables["start"].select(F.lit("start").alias("parameter"), "state", F.lit("state").alias("target"), F.col("p").alias("value"))
    steps = tables["transition"].select(F.lit("transition").alias("parameter"), F.col("from_state").alias("state"), F.col("to_state").cast("string").alias("target"), F.col("p").alias("value"))
    means = tables["emission"].select(F.lit("emission").alias("parameter"), "state", F.col("feature").alias("target"), F.col("mean").alias("value"))
    return start.union(steps).union(means).withColumn("value", r6("value"))


@query("hm15_transition_wide", ["em_steps"],
       "SELECT 'from_state_' || i AS from_state, " + ", ".join(f"{sql6(f'max(p) FILTER (WHERE j = {j})')} AS to_state_{j}" for j in range(_K)) + " FROM em_steps GROUP BY i", extra=_ORDERED)
def hm15_wide(ctx):
    """The transition matrix as one row per state."""
    wide = st.transition_wide(_updated_tables(ctx)["transition"], _K)
    return wide.withColumns({f"to_state_{j}": r6(f"to_state_{j}") for j in range(_K)})


@query("hm16_control_only_refit")
def hm16(ctx):
    """Fit on the control arm, decode everyone, repeat the order test."""
    return control_only_refit(ctx.usable, ctx.outcomes, ctx.spec, 2, 44, 3)


# --- dynamics ---------------------------------------------------------------------------


@query("ag12_occupancy", ["test_scored"],
       f"SELECT arm, t, count(*) AS n_sessions, {sql6('avg(expected_state)')} AS mean_expected_state, " + ", ".join(f"{sql6(f'avg((state = {k})::INTEGER)')} AS fraction_state_{k}" for k in range(_K)) + " FROM test_scored GROUP BY arm, t")
def ag12(ctx):
    table = st.occupancy(ctx.scored, _K)
    return table.withColumns({c: r6(c) for c in table.columns if c.startswith(("mean_", "fraction_"))})


@query("ag13_transition_summary", ["changes"],
       f"SELECT a.arm, count(c.change) AS n_transitions, {sql6('count(*) FILTER (WHERE change > 0) / nullif(count(c.change), 0)')} AS worsening_fraction, "
       f"{sql6('count(*) FILTER (WHERE change < 0) / nullif(count(c.change), 0)')} AS recovery_fraction, {sql6('count(*) FILTER (WHERE change = 0) / nullif(count(c.change), 0)')} AS stable_fraction "
       "FROM (VALUES ('a0'), ('a1'), ('a2'), ('a3')) AS a(arm) LEFT JOIN changes c ON a.arm = c.arm GROUP BY a.arm", extra=_CHANGES)
def ag13(ctx):
    table = st.transition_summary(ctx.scored, ctx.spec)
    return table.withColumns({c: r6(c) for c in table.columns if c.endswith("_fraction")})


@query("ag14_occupancy_text", ["test_scored"],
       "SELECT string_agg(arm || ' ' || CAST(share AS VARCHAR) || '%', ', ' ORDER BY arm) AS occupancy FROM (SELECT arm, CAST(round_even(100 * avg((state = 0)::INTEGER), 0) AS INTEGER) AS share FROM test_scored WHERE t = 6 GROUP BY arm)")
def ag14(ctx):
    return st.occupancy_text(st.occupancy(ctx.scored, _K), 0, ctx.spec.t_target)


@query("ag15_mean_state", ["decoded"], f"SELECT subject_id, {sql6('avg(severity)')} AS mean_state_index, count(*) AS n FROM decoded GROUP BY subject_id")
def ag15(ctx):
    """The subject means computed from decoded session rows."""
    rows = st.score_sessions(ctx.decoded)
    return rows.groupBy("subject_id").agg(r6(F.avg("state")).alias("mean_state_index"), _n().alias("n"))


@query("st17_bic", ["bics"], f"SELECT n_states, n_parameters, n_sessions, {sql6('loglik')} AS loglik, {sql6('bic')} AS bic FROM bics", extra=_BIC)
def st17(ctx):
    return _with_bic(_two_models(ctx)).select("n_states", "n_parameters", "n_sessions", r6("loglik").alias("loglik"), r6("bic").alias("bic"))


_FOLD_LL = {
    "fold_ll": (
        ["loglik", "folds"],
        "SELECT f.fold, sum(l.loglik) / sum(c.n) AS per_session FROM folds f JOIN loglik l USING (subject_id) JOIN (SELECT subject_id, count(*) AS n FROM scaled GROUP BY subject_id) c USING (subject_id) GROUP BY f.fold",
    )
}


@query("st18_fold_summary", ["fold_ll"],
       f"SELECT 3 AS n_states, {sql6('avg(per_session)')} AS cv_loglik_per_session, {sql6('stddev_samp(per_session)')} AS cv_sd, {sql6('stddev_samp(per_session) / sqrt(count(*))')} AS cv_se FROM fold_ll", extra=_FOLD_LL)
def st18(ctx):
    """Mean, sample deviation, and standard error over folds of the fixed model's likelihood per session."""
    scores = infer(ctx.sequences, ctx.model).select("subject_id", "loglik", F.size("xs").alias("n")).join(by_key(ctx.folds), "subject_id")
    folds = scores.groupBy("fold").agg((F.sum("loglik") / F.sum("n")).alias("loglik_per_session")).withColumn("n_states", F.lit(3))
    return fold_summary(folds).withColumns({c: r6(c) for c in ("cv_loglik_per_session", "cv_sd", "cv_se")})
