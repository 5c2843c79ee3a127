"""Queries over evaluation statistics: ranks, ROC, resampling, adjustment, baseline, controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpanel.functions.columns import r6
from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.sampling import stage_seed
from driftpanel.operators import behavior as behave
from driftpanel.operators import ordering, stats
from driftpanel.operators.baseline import GRID_C, GRID_L1, fit_baseline, fit_candidates, fold_table, predict_baseline, violations
from driftpanel.operators.sequences import restrict
from driftpanel.operators.states import occupancy
from driftpanel.plans.analysis import as_metrics, landmark_vectors, score_metrics
from driftpanel.plans.context import FIXED_BASELINE
from driftpanel.plans.oracle import mid_rank, r6 as sql6, tree_tables
from driftpanel.plans.registry import query

SEED = 42
RHO_DRAWS, PERMUTATIONS = ordering.BOOTSTRAP_ITERATIONS, ordering.PERMUTATION_ITERATIONS
FORECAST_DRAWS = 1_000


# --- exact statistics -------------------------------------------------------------------

_AUC_SQL = (
    "(sum({rank}) FILTER (WHERE target = 1) - count(*) FILTER (WHERE target = 1) * (count(*) FILTER (WHERE target = 1) + 1) / 2.0::DOUBLE) "
    "/ (count(*) FILTER (WHERE target = 1) * count(*) FILTER (WHERE target = 0))"
)


def _auc(score: str, source: str) -> str:
    return f"SELECT {_AUC_SQL.format(rank='rk')} FROM (SELECT target, {mid_rank(score)} AS rk FROM {source})"


def _ap(score: str, source: str) -> str:
    return (
        f"SELECT sum(tp * cum_tp / cum_n) / sum(tp) FROM (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS cum_tp, sum(n) OVER (ORDER BY s DESC) AS cum_n "
        f"FROM (SELECT {score} AS s, count(*) AS n, count(*) FILTER (WHERE target = 1) AS tp FROM {source} GROUP BY {score}))"
    )


@query("st1_roc_auc", ["forecasts"],
       f"SELECT (SELECT count(*) FROM forecasts WHERE target = 1) AS n_positive, (SELECT count(*) FROM forecasts WHERE target = 0) AS n_negative, {sql6(f'({_auc('risk', 'forecasts')})')} AS roc_auc")
def st1(ctx):
    return stats.roc_auc(ctx.forecasts, "risk", "target").withColumn("roc_auc", r6("roc_auc"))


@query("st2_average_precision", ["forecasts"], f"SELECT {sql6(f'({_ap('risk', 'forecasts')})')} AS average_precision")
def st2(ctx):
    return stats.average_precision(ctx.forecasts, "risk", "target").withColumn("average_precision", r6("average_precision"))


@query("st3_roc_curve", ["forecasts"],
       f"SELECT {sql6('fpr')} AS fpr, {sql6('tpr')} AS tpr FROM (SELECT 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL SELECT sum(count(*) FILTER (WHERE target = 0)) OVER (ORDER BY risk DESC) / (SELECT count(*) FROM forecasts WHERE target = 0), "
       "sum(count(*) FILTER (WHERE target = 1)) OVER (ORDER BY risk DESC) / (SELECT count(*) FROM forecasts WHERE target = 1) FROM forecasts GROUP BY risk)")
def st3(ctx):
    return stats.roc_points(ctx.forecasts, "risk", "target").select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def _rho(x: str, y: str, source: str) -> str:
    return f"SELECT count(*) AS n, {sql6('corr(rx, ry)')} AS rho FROM (SELECT {mid_rank(x)} AS rx, {mid_rank(y)} AS ry FROM {source})"


@query("st4_spearman", ["ranked_index"], _rho("x", "y", "ranked_index"))
def st4(ctx):
    joined = ordering.with_arm(ctx.index, ctx.outcomes)
    return stats.spearman_ordinal(joined, "mean_state_index", "arm", ctx.spec.arms).withColumn("rho", r6("rho"))


def _p_sql(rho: str, n: str, steps: int = 4000) -> str:
    """Two-sided p of a correlation: the share of cos(a)^(n - 3) beyond asin(|rho|), both integrals by Simpson's rule."""
    def area(low: str) -> str:
        weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        angle = f"({low} + (pi() / 2 - {low}) * i / {steps})"
        return f"((pi() / 2 - {low}) * (SELECT sum({weight} * pow(greatest(cos{angle}, 0), {n} - 3)) FROM range({steps + 1}) steps(i)))"

    return f"{area(f'asin(abs({rho}))')} / {area('0')}"


def _with_p(rho_sql: str) -> str:
    """``n, rho, p`` from a select of ``n`` and an unrounded ``rho``."""
    return f"SELECT n, {sql6('rho')} AS rho, {sql6(_p_sql('rho', 'n'))} AS p FROM ({rho_sql})"


def _raw_rho(x: str, y: str, source: str) -> str:
    return f"SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {mid_rank(x)} AS rx, {mid_rank(y)} AS ry FROM {source})"


@query("st4_p_value", ["forecasts", "ranked_index"],
       _with_p(_raw_rho("risk", "y", "(SELECT f.risk, r.y FROM forecasts f JOIN ranked_index r USING (subject_id))")))
def st4_p(ctx):
    """Spearman of risk against mean state, with its two-sided p-value."""
    joined = ctx.forecasts.join(by_key(ctx.index), "subject_id")
    return stats.with_p_value(stats.spearman(joined, "risk", "mean_state_index")).withColumns({c: r6(c) for c in ("rho", "p")})


@query("st11_dose_risk_rho", ["forecasts"], _rho("dose", "risk", "forecasts"))
def st11(ctx):
    return behave.dose_risk_rho(ctx.forecasts).withColumn("rho", r6("rho"))


@query("st11_dynamics_report", ["test_scored"],
       f"SELECT arm, CAST(t AS VARCHAR) AS period, {sql6('avg(expected_state)')} AS mean_expected_state, count(*)::DOUBLE AS n FROM test_scored GROUP BY arm, t")
def st11_report(ctx):
    table = occupancy(ctx.scored, ctx.model.n_states)
    return table.select("arm", F.col("t").cast("string").alias("period"), r6("mean_expected_state").alias("mean_expected_state"), F.col("n_sessions").cast("double").alias("n"))


@query("st12_leave_one_arm_out", ["ranked_index"],
       f"SELECT held_out, count(*) AS n, {sql6('corr(rx, ry)')} AS rho FROM (SELECT held_out, {mid_rank('x', 'held_out')} AS rx, {mid_rank('y', 'held_out')} AS ry "
       "FROM (SELECT h.arm AS held_out, r.x, r.y FROM (VALUES ('a0'), ('a1'), ('a2'), ('a3')) AS h(arm) JOIN ranked_index r ON r.arm <> h.arm)) GROUP BY held_out")
def st12(ctx):
    return ordering.leave_one_arm_out(ctx.index, ctx.outcomes, ctx.spec).withColumn("rho", r6("rho"))


# --- resampling -------------------------------------------------------------------------


_TREE_CELLS = "SELECT value_no, class, count(*) AS size FROM (SELECT dense_rank() OVER (ORDER BY {value}) - 1 AS value_no, {cls} AS class FROM {source}) GROUP BY value_no, class"


def _order_sources(source: str = "ranked_index", where: str = "") -> dict:
    return {
        "positions": ([source, "test"], f"SELECT x, y FROM {source} {where}"),
        "tree_cells": (["positions"], _TREE_CELLS.format(value="y", cls="x", source="positions")),
    }


_IN_TEST = "WHERE subject_id IN (SELECT subject_id FROM test)"


def _draws(kind: str, seed: int, iterations: int, source: dict, name: str, suffix: str) -> dict:
    """Correlations ``name`` of every iteration: the drawn cells back to rows, ranked and correlated."""
    rho = "CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END"
    rows = f"SELECT iter, class AS x, value_no AS y FROM tree_drawn{suffix}, range(n)"
    return {
        **source,
        **tree_tables(kind, seed, iterations, 4, suffix=suffix),
        name: ([f"tree_drawn{suffix}"], f"SELECT iter, {rho} AS rho FROM (SELECT iter, x, y, {mid_rank('x', 'iter')} AS rx, {mid_rank('y', 'iter')} AS ry FROM ({rows})) GROUP BY iter"),
    }


def _bootstrap(seed: int, iterations: int, source: dict) -> dict:
    return _draws("bootstrap", seed, iterations, source, "boot", "")


def _permutation(seed: int, iterations: int, source: dict) -> dict:
    return _draws("permutation", seed, iterations, source, "null_p", "_p")


def _profile(ctx, index=None):
    return cut_lineage(ordering.arm_profile(ordering.with_arm(ctx.index if index is None else index, ctx.outcomes), ctx.spec))


@query("st5_bootstrap_rho", ["boot"], f"SELECT CAST(iter AS INTEGER) AS iter, {sql6('rho')} AS rho FROM boot", extra=_bootstrap(SEED, RHO_DRAWS, _order_sources()))
def st5(ctx):
    return ordering.rho_draws(_profile(ctx), ctx.spec, "bootstrap", SEED, RHO_DRAWS).withColumn("rho", r6("rho"))


@query("st6_permutation_rho", ["null_p"], f"SELECT CAST(iter AS INTEGER) AS iter, {sql6('rho')} AS rho FROM null_p", extra=_permutation(stage_seed(SEED, "permutation"), PERMUTATIONS, _order_sources()))
def st6(ctx):
    return ordering.rho_draws(_profile(ctx), ctx.spec, "permutation", stage_seed(SEED, "permutation"), PERMUTATIONS).withColumn("rho", r6("rho"))


def _primary_sql(seed: int, where: str) -> tuple[dict, str]:
    source = _order_sources(where=where)
    tables = {**_bootstrap(seed, RHO_DRAWS, source), **_permutation(stage_seed(seed, "permutation"), PERMUTATIONS, source)}
    tables["seen"] = (["positions"], f"SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {mid_rank('x')} AS rx, {mid_rank('y')} AS ry FROM positions)")
    select = (
        f"SELECT s.n, {sql6('s.rho')} AS rho, b.n_draws, {sql6('b.ci_low')} AS ci_low, {sql6('b.ci_high')} AS ci_high, p.n_permutations, {sql6('p.null_mean')} AS null_mean, {sql6('p.null_sd')} AS null_sd, {sql6('p.one_sided_p')} AS one_sided_p "
        "FROM seen s, (SELECT count(rho) AS n_draws, quantile_cont(rho, 0.025) AS ci_low, quantile_cont(rho, 0.975) AS ci_high FROM boot) b, "
        "(SELECT count(rho) AS n_permutations, avg(rho) AS null_mean, stddev_pop(rho) AS null_sd, (count(*) FILTER (WHERE rho >= (SELECT rho FROM seen) - 1e-12) + 1) / (count(rho) + 1) AS one_sided_p FROM null_p) p"
    )
    return tables, select


_ROUNDED = ("rho", "ci_low", "ci_high", "null_mean", "null_sd", "one_sided_p")


def _primary(name: str, seed: int, held_out: bool):
    tables, select = _primary_sql(seed, _IN_TEST if held_out else "")

    @query(name, ["seen", "boot", "null_p"], select, extra=tables)
    def run(ctx):
        index = restrict(ctx.index, ctx.test) if held_out else ctx.index
        table = ordering.primary_test(index, ctx.outcomes, ctx.spec, seed)
        return table.withColumns({c: r6(c) for c in _ROUNDED})


_primary("st6_order_test", SEED, held_out=False)
_primary("st13_held_out_order_test", stage_seed(SEED, "held out"), held_out=True)


@query("ag20_percentile_interval", ["boot"],
       f"SELECT count(rho) AS n_draws, {sql6('quantile_cont(rho, 0.025)')} AS ci_low, {sql6('quantile_cont(rho, 0.975)')} AS ci_high FROM boot", extra=_bootstrap(SEED, RHO_DRAWS, _order_sources()))
def ag20(ctx):
    draws = ordering.rho_draws(_profile(ctx), ctx.spec, "bootstrap", SEED, RHO_DRAWS)
    return stats.percentile_interval(draws, "rho").withColumns({c: r6(c) for c in ("ci_low", "ci_high")})


_FORECAST_BOOT = {
    "tree_cells": (["forecasts"], _TREE_CELLS.format(value="risk", cls="target", source="forecasts")),
    **tree_tables("bootstrap", stage_seed(SEED, "forecast"), FORECAST_DRAWS, 2),
    "drawn": (["tree_drawn"], "SELECT iter, value_no AS risk, class AS target FROM tree_drawn, range(n)"),
    "drawn_auc": (
        ["drawn"],
        f"SELECT iter, {_AUC_SQL.format(rank='rk')} AS auc FROM (SELECT iter, target, {mid_rank('risk', 'iter')} AS rk FROM drawn) GROUP BY iter HAVING min(target) < max(target)",
    ),
    "drawn_ap": (
        ["drawn"],
        "SELECT iter, sum(tp * cum_tp / cum_n) / sum(tp) AS ap FROM (SELECT iter, tp, sum(tp) OVER (PARTITION BY iter ORDER BY risk DESC) AS cum_tp, sum(n) OVER (PARTITION BY iter ORDER BY risk DESC) AS cum_n "
        "FROM (SELECT iter, risk, count(*) AS n, count(*) FILTER (WHERE target = 1) AS tp FROM drawn GROUP BY iter, risk)) GROUP BY iter",
    ),
}


@query("st7_forecast_bootstrap", ["drawn_auc", "drawn_ap"],
       f"SELECT CAST(i.iter AS INTEGER) AS iter, {sql6('a.auc')} AS roc_auc, CASE WHEN a.auc IS NOT NULL THEN {sql6('p.ap')} END AS average_precision FROM (SELECT DISTINCT iter FROM drawn) i LEFT JOIN drawn_auc a USING (iter) LEFT JOIN drawn_ap p USING (iter)",
       extra=_FORECAST_BOOT)
def st7(ctx):
    return ordering.forecast_draws(ctx.forecasts, stage_seed(SEED, "forecast"), FORECAST_DRAWS).withColumns({c: r6(c) for c in ("roc_auc", "average_precision")})


# --- adjustment -------------------------------------------------------------------------


def _adjusted_sql(source: str, x: str, y: str, regressors: list[str]) -> tuple[dict, str]:
    """Partial rank correlation by orthogonalising the regressors one after another."""
    p = len(regressors)
    first = ", ".join([f"{mid_rank(x)} AS a", f"{mid_rank(y)} AS b", *[f"({z})::DOUBLE AS z{i}" for i, z in enumerate(regressors)]])
    tables = {"ortho0": ([source], f"SELECT {first} FROM {source}")}
    for i in range(p):
        cells = [f"CASE WHEN sum(z{i} * z{i}) OVER () > 1e-9 THEN {c} - z{i} * sum(z{i} * {c}) OVER () / sum(z{i} * z{i}) OVER () ELSE {c} END AS {c}"
                 for c in ("a", "b", *[f"z{j}" for j in range(i + 1, p)])]
        tables[f"ortho{i + 1}"] = ([f"ortho{i}"], f"SELECT {', '.join(cells)} FROM ortho{i}")
    select = _with_p(f"SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT {mid_rank('round(a, 8)')} AS ra, {mid_rank('round(b, 8)')} AS rb FROM ortho{p})")
    return tables, select


_ST8_TABLES, _ST8_SQL = _adjusted_sql(
    "merged_behavior", "risk", "abnormality", ["1", "ln(1 + dose) - 5", "(arm = 'a1')::INTEGER", "(arm = 'a2')::INTEGER", "(arm = 'a3')::INTEGER", "(batch = 1)::INTEGER", "(batch = 2)::INTEGER"]
)


@query("st8_partial_spearman", ["ortho7"], _ST8_SQL, extra=_ST8_TABLES)
def st8(ctx):
    return stats.with_p_value(behave.adjusted_behavior_rho(ctx.merged_behavior)).withColumns({c: r6(c) for c in ("rho", "p")})


_ADJUSTED_INDEX = {
    "adjusted_index": (
        ["ranked_index", "usable"],
        "SELECT r.x, r.y, c.* FROM ranked_index r JOIN (SELECT subject_id, arg_min(batch, t) AS batch, arg_min(clutch, t) AS clutch, avg(hour(started_at) + minute(started_at) / 60.0::DOUBLE) AS mean_hour, "
        "avg(shift) AS mean_shift FROM usable GROUP BY subject_id) c USING (subject_id)",
    )
}
_ST9_TABLES, _ST9_SQL = _adjusted_sql(
    "adjusted_index", "x", "y",
    ["1", "mean_hour - 12", "mean_shift - 20", "(batch = 1)::INTEGER", "(batch = 2)::INTEGER", *[f"(clutch = 'c{i}')::INTEGER" for i in range(1, 5)]],
)


@query("st9_adjusted_order", ["ortho9"], _ST9_SQL, extra={**_ADJUSTED_INDEX, **_ST9_TABLES})
def st9(ctx):
    return stats.with_p_value(ordering.covariate_adjusted(ctx.index, ctx.outcomes, ctx.usable, ctx.spec)).withColumns({c: r6(c) for c in ("rho", "p")})


@query("st10_behavior_validation", ["merged_behavior"], _rho("risk", "abnormality", "merged_behavior"))
def st10(ctx):
    return behave.behavior_rho(ctx.merged_behavior).withColumn("rho", r6("rho"))


@query("st10_merged_table", ["merged_behavior"],
       f"SELECT subject_id, {sql6('risk')} AS risk, {sql6('abnormality')} AS abnormality, {sql6('mean_speed')} AS mean_speed, {sql6('rest_fraction')} AS rest_fraction, {sql6('whirl_rate')} AS whirl_rate, stage_max FROM merged_behavior")
def st10_table(ctx):
    doubles = ("risk", "abnormality", "mean_speed", "rest_fraction", "whirl_rate")
    return ctx.merged_behavior.select("subject_id", *[r6(c).alias(c) for c in doubles], "stage_max")


# --- controls and baseline --------------------------------------------------------------


@query("st14_negative_controls")
def st14(ctx):
    """Shuffled labels, control-only refit, and leave-one-arm-out as one long table."""
    primary = ordering.primary_test(ctx.index, ctx.outcomes, ctx.spec, SEED)
    refit = ordering.control_only_refit(ctx.usable, ctx.outcomes, ctx.spec, 2, SEED + 2, 3)
    return ordering.negative_controls(primary, refit, ordering.leave_one_arm_out(ctx.index, ctx.outcomes, ctx.spec))


@query("st15_elastic_net_baseline")
def st15(ctx):
    """Grid-searched baseline: chosen strengths and held-out metrics."""
    vectors = cut_lineage(landmark_vectors(ctx.usable, ctx.outcomes, ctx.scaler, ctx.spec))
    baseline = fit_baseline(restrict(vectors, ctx.train))
    predictions = cut_lineage(predict_baseline(restrict(vectors, ctx.test), baseline))
    chosen = ctx.spark.createDataFrame([(baseline.c, baseline.l1, baseline.n_train)], "chosen_c double, chosen_l1 double, n_train long")
    return score_metrics(predictions).crossJoin(F.broadcast(chosen))


@query("st15_optimality", [], "SELECT c, l1, 0.0::DOUBLE AS violation, 6 * 5::BIGINT AS n_coefficients FROM (VALUES "
       + ", ".join(f"({c!r}::DOUBLE)" for c in GRID_C) + ") AS a(c), (VALUES " + ", ".join(f"({r!r}::DOUBLE)" for r in GRID_L1) + ") AS b(l1)")
def st15_optimality(ctx):
    """The largest violation of the conditions of an optimum over the six fits of each candidate, at six places: 0 at every optimum."""
    vectors = cut_lineage(landmark_vectors(ctx.usable, ctx.outcomes, ctx.scaler, ctx.spec))
    table = fold_table(restrict(vectors, ctx.train), 5, SEED)
    try:
        _, grid, betas = fit_candidates(table, 5)
        found = violations(table, grid, betas)
    finally:
        table.unpersist()
    return found.groupBy("c", "l1").agg(r6(F.max("violation")).alias("violation"), F.count(F.lit(1)).alias("n_coefficients"))


_BASELINE_RISK = "1 / (1 + exp(-(" + " + ".join([repr(float(FIXED_BASELINE.beta[0])), *[f"({float(b)!r}::DOUBLE) * s.x{d}" for d, b in enumerate(FIXED_BASELINE.beta[1:])]]) + ")))"


def _three_metrics(score: str) -> str:
    return (
        f"SELECT 'roc_auc' AS metric, ({_auc(score, 'forecasts')}) AS value UNION ALL SELECT 'average_precision', ({_ap(score, 'forecasts')}) "
        f"UNION ALL SELECT 'brier_score', avg(({score} - target) * ({score} - target)) FROM forecasts"
    )


@query("st16_model_comparison", ["forecasts"],
       f"SELECT f.metric, {sql6('f.value')} AS forecast, {sql6('b.value')} AS baseline, CASE WHEN round(f.value, 9) = round(b.value, 9) THEN 'tie' WHEN (f.value < b.value) = (f.metric = 'brier_score') THEN 'forecast' ELSE 'baseline' END AS ahead "
       f"FROM ({_three_metrics('risk')}) f JOIN ({_three_metrics('current_risk')}) b USING (metric)")
def st16(ctx):
    """The propagated forecast against the unpropagated current risk."""
    named = F.col("metric").isin("roc_auc", "average_precision", "brier_score")

    def metrics(risk: str):
        rows = as_metrics(score_metrics(ctx.forecasts, risk), "m").where(named)
        return rows.withColumn("value", F.round("value", 9))

    table = behave.compare_models(metrics("risk"), metrics("current_risk"))
    return table.withColumns({c: r6(c) for c in ("forecast", "baseline")})


@query("st16_against_baseline", ["forecasts", "both_models"],
       f"SELECT f.metric, {sql6('f.value')} AS forecast, {sql6('b.value')} AS baseline, CASE WHEN round(f.value, 9) = round(b.value, 9) THEN 'tie' WHEN (f.value < b.value) = (f.metric = 'brier_score') THEN 'forecast' ELSE 'baseline' END AS ahead "
       f"FROM ({_three_metrics('risk')}) f JOIN ({_three_metrics('baseline_risk').replace('forecasts', 'both_models')}) b USING (metric)",
       extra={
           "both_models": (
               ["scaled", "outcomes", "test"],
               f"SELECT s.subject_id, o.target, {_BASELINE_RISK} AS baseline_risk FROM scaled s JOIN outcomes o USING (subject_id) "
               "WHERE o.target IS NOT NULL AND s.subject_id IN (SELECT subject_id FROM test) AND s.t = (SELECT max(q.t) FROM scaled q WHERE q.subject_id = s.subject_id AND q.t <= 5)",
           ),
       })
def st16_baseline(ctx):
    """The forecast against an elastic-net model on the landmark session of the same subjects."""
    vectors = landmark_vectors(ctx.usable, ctx.outcomes, ctx.scaler, ctx.spec)
    predictions = cut_lineage(predict_baseline(restrict(vectors, ctx.test), FIXED_BASELINE))
    named = F.col("metric").isin("roc_auc", "average_precision", "brier_score")
    metrics = lambda df: as_metrics(score_metrics(df), "m").where(named).withColumn("value", F.round("value", 9))
    table = behave.compare_models(metrics(ctx.forecasts), metrics(predictions))
    return table.withColumns({c: r6(c) for c in ("forecast", "baseline")})
