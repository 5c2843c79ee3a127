"""SQL text of the study tables, for checking every operator against another engine.

Each fragment is one common table expression; ``compose`` puts the needed ones in front of a
final SELECT.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from driftpanel.functions.sampling import DRAW_BITS, LEVEL_BITS, MIX64, iteration_keys
from driftpanel.operators.hmm import centre_key
from driftpanel.plans.context import FIXED_MODEL, FIXED_TWO_STATE

FEATURES = ("f_var", "f_peak", "f_rate", "f_pow4")


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def _model_tables(model, prefix: str = "") -> dict[str, tuple[list[str], str]]:
    score = model.means.mean(axis=1)
    severity = np.empty(len(score), dtype=int)
    severity[np.argsort(score, kind="stable")] = np.arange(len(score))
    states = []
    for k in range(model.n_states):
        numbers = [model.start[k], *model.means[k], *model.covars[k]]
        states.append(f"({k}, {severity[k]}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in numbers) + ")")
    names = ", ".join([f"m{d}" for d in range(4)] + [f"v{d}" for d in range(4)])
    steps = [
        f"({i}, {j}, {float(model.trans[i, j])!r}::DOUBLE)" for i in range(model.n_states) for j in range(model.n_states)
    ]
    return {
        f"{prefix}states": ([], f"SELECT * FROM (VALUES {', '.join(states)}) AS v(k, severity, start, {names})"),
        f"{prefix}steps": ([], f"SELECT * FROM (VALUES {', '.join(steps)}) AS v(i, j, p)"),
    }


_QUADRATIC = " + ".join(f"(s.x{d} - m.m{d}) * (s.x{d} - m.m{d}) / m.v{d} + ln(m.v{d})" for d in range(4))


def _inference(prefix: str = "") -> dict[str, tuple[list[str], str]]:
    """Filter, likelihood, and Viterbi for sequences of up to three positions."""
    p = prefix
    out = {
        f"{p}emit": (
            ["scaled", f"{p}states"],
            "SELECT s.subject_id, s.pos, m.k, m.severity, "
            f"-0.5 * (4 * ln(2 * pi()) + {_QUADRATIC}) AS logb FROM scaled s, {p}states m",
        ),
        f"{p}peaked": (
            [f"{p}emit"],
            "SELECT *, max(logb) OVER (PARTITION BY subject_id, pos) AS peak, "
            f"exp(logb - max(logb) OVER (PARTITION BY subject_id, pos)) AS b FROM {p}emit",
        ),
        f"{p}un0": (
            [f"{p}peaked"],
            f"SELECT e.subject_id, e.k, m.start * e.b AS u, e.peak FROM {p}peaked e JOIN {p}states m ON e.k = m.k WHERE e.pos = 0",
        ),
    }
    for t in range(3):
        out[f"{p}f{t}"] = (
            [f"{p}un{t}", f"{p}steps"],
            f"SELECT subject_id, {t} AS pos, k, u / sum(u) OVER (PARTITION BY subject_id) AS p, "
            f"ln(sum(u) OVER (PARTITION BY subject_id)) + peak AS gain FROM {p}un{t}",
        )
        if t < 2:
            out[f"{p}un{t + 1}"] = (
                [f"{p}f{t}", f"{p}peaked", f"{p}steps"],
                "SELECT e.subject_id, e.k, sum(f.p * a.p) * any_value(e.b) AS u, any_value(e.peak) AS peak "
                f"FROM {p}peaked e JOIN {p}f{t} f ON e.subject_id = f.subject_id "
                f"JOIN {p}steps a ON a.i = f.k AND a.j = e.k WHERE e.pos = {t + 1} GROUP BY e.subject_id, e.k",
            )
    out[f"{p}posterior"] = (
        [f"{p}f2", f"{p}states"],
        "SELECT f.subject_id, f.pos, f.k, m.severity, f.p, f.gain FROM ("
        + " UNION ALL ".join(f"SELECT * FROM {p}f{t}" for t in range(3))
        + f") f JOIN {p}states m ON f.k = m.k",
    )
    out[f"{p}loglik"] = (
        [f"{p}posterior"],
        f"SELECT subject_id, sum(gain) AS loglik, count(*) AS n FROM (SELECT DISTINCT subject_id, pos, gain FROM {p}posterior) GROUP BY subject_id",
    )
    out[f"{p}paths"] = (
        [f"{p}emit", f"{p}steps", f"{p}states"],
        "SELECT e0.subject_id, e0.k AS k0, e1.k AS k1, e2.k AS k2, "
        "ln(m.start) + e0.logb + coalesce(ln(a1.p) + e1.logb, 0) + coalesce(ln(a2.p) + e2.logb, 0) AS score "
        f"FROM {p}emit e0 JOIN {p}states m ON m.k = e0.k "
        f"LEFT JOIN {p}emit e1 ON e1.subject_id = e0.subject_id AND e1.pos = 1 "
        f"LEFT JOIN {p}steps a1 ON a1.i = e0.k AND a1.j = e1.k "
        f"LEFT JOIN {p}emit e2 ON e2.subject_id = e0.subject_id AND e2.pos = 2 "
        f"LEFT JOIN {p}steps a2 ON a2.i = e1.k AND a2.j = e2.k WHERE e0.pos = 0",
    )
    out[f"{p}best_path"] = (
        [f"{p}paths"],
        f"SELECT subject_id, arg_max(k0, score) AS k0, arg_max(k1, score) AS k1, arg_max(k2, score) AS k2 FROM {p}paths GROUP BY subject_id",
    )
    out[f"{p}decoded"] = (
        [f"{p}best_path", f"{p}states"],
        "SELECT b.subject_id, b.pos, b.k, m.severity FROM ("
        + " UNION ALL ".join(f"SELECT subject_id, {t} AS pos, k{t} AS k FROM {p}best_path WHERE k{t} IS NOT NULL" for t in range(3))
        + f") b JOIN {p}states m ON b.k = m.k",
    )
    return out


FRAGMENTS: dict[str, tuple[list[str], str]] = {
    "ev": (
        [],
        "SELECT event_id, ts, user_id, event_type, value, "
        "CAST(floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 10) AS INTEGER) + 4 AS t FROM events",
    ),
    "sessions": (
        ["ev"],
        "SELECT CAST(user_id AS VARCHAR) AS subject_id, 'a' || (user_id % 4) AS arm, CAST(user_id % 3 AS INTEGER) AS batch, "
        "'c' || (user_id % 5) AS clutch, 'p' || (user_id % 7) AS plate, 3 AS baseline_t, t, CAST(user_id % 4 AS INTEGER) AS n_drops, "
        "90.0::DOUBLE * (user_id % 4) + t AS pressure, 100.0::DOUBLE * (user_id % 4) + user_id % 10 AS dose, 0.05::DOUBLE AS noise, "
        "shift, shift <= 50 AS qc_pass, started_at, f_var, f_peak, f_rate, f_pow4 FROM ("
        "SELECT user_id, t, count(*) FILTER (WHERE event_type = 'view') * 100.0::DOUBLE / count(*) AS shift, min(ts) AS started_at, "
        "var_pop(value) AS f_var, max(value) / (1 + avg(value)) AS f_peak, "
        "count(*) FILTER (WHERE event_type = 'error') / 2.0::DOUBLE AS f_rate, avg(power(value, 4)) AS f_pow4 "
        "FROM ev WHERE event_id % 2 = 0 GROUP BY user_id, t)",
    ),
    "log": (
        ["ev"],
        "SELECT CAST(user_id AS VARCHAR) AS subject_id, t, event_type = 'error' AND value >= 20 AS qualifies, "
        "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS stage, "
        "CASE event_type WHEN 'error' THEN 'convulsion_posture_loss' WHEN 'purchase' THEN 'whirlpool' ELSE 'swim' END AS behavior_class, "
        "300.0::DOUBLE AS session_duration_s, value AS event_duration_s, value / 10 AS mean_velocity, "
        "value / 5 AS peak_velocity, value / 4 AS rms_bend, value / 2 AS max_bend, "
        "0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS likelihood, event_id % 20 <> 1 AS tracking_qc_pass FROM ev WHERE event_id % 2 = 1",
    ),
    "raw_outcomes": (
        ["ev"],
        "SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id, CAST(user_id % 2 AS INTEGER) AS became_positive, "
        "CAST(NULL AS DOUBLE) AS first_event_hours FROM ev",
    ),
    "observed": (
        ["sessions", "log"],
        "SELECT subject_id FROM sessions WHERE t = 6 UNION SELECT subject_id FROM log WHERE t = 6",
    ),
    "positives": (["log"], "SELECT DISTINCT subject_id FROM log WHERE qualifies AND t = 6"),
    "endpoint": (
        ["observed", "positives"],
        "SELECT o.subject_id, CASE WHEN p.subject_id IS NULL THEN 0 ELSE 1 END AS target FROM observed o LEFT JOIN positives p USING (subject_id)",
    ),
    "metadata": (
        ["sessions"],
        "SELECT subject_id, arg_min(arm, t) AS arm, arg_min(batch, t) AS batch, arg_min(clutch, t) AS clutch, arg_min(plate, t) AS plate, "
        "arg_min(n_drops, t) AS n_drops, avg(pressure) AS pressure, max(dose) AS dose, max(t) AS last_t, count(*) AS n_sessions "
        "FROM sessions GROUP BY subject_id",
    ),
    "stages": (["log"], "SELECT subject_id, max(stage) AS max_stage FROM log GROUP BY subject_id"),
    "outcomes": (
        ["metadata", "raw_outcomes", "endpoint", "stages"],
        "SELECT m.*, r.became_positive, r.first_event_hours, e.target, coalesce(s.max_stage, 0) AS max_stage, m.last_t >= 6 AS survived "
        "FROM metadata m LEFT JOIN raw_outcomes r USING (subject_id) LEFT JOIN endpoint e USING (subject_id) LEFT JOIN stages s USING (subject_id)",
    ),
    "logged": (
        ["log"],
        "SELECT subject_id, t, min(session_duration_s / 60.0::DOUBLE) AS session_minutes, count(*) AS n_events, "
        "count(*) FILTER (WHERE stage >= 1) AS n_abnormal, count(*) FILTER (WHERE stage >= 2) AS n_severe, "
        "count(*) FILTER (WHERE behavior_class = 'whirlpool') AS n_whirl, "
        "count(*) FILTER (WHERE behavior_class = 'convulsion_posture_loss') AS n_convulsion, sum(event_duration_s) AS event_seconds, "
        "max(stage) AS stage_max, avg(mean_velocity) AS mean_speed, max(peak_velocity) AS max_speed, avg(rms_bend) AS mean_bend, "
        "max(max_bend) AS max_bend, avg(likelihood) AS mean_likelihood, bool_and(tracking_qc_pass) AS tracking_qc_pass "
        "FROM log GROUP BY subject_id, t",
    ),
    "scaffold": (["sessions"], "SELECT DISTINCT subject_id, arm, t FROM sessions"),
    "median_minutes": (["log"], "SELECT coalesce(median(session_duration_s / 60.0::DOUBLE), 5.0::DOUBLE) AS minutes FROM log"),
    "filled": (
        ["scaffold", "logged", "median_minutes"],
        "SELECT s.subject_id, s.t, s.arm, coalesce(l.session_minutes, m.minutes) AS session_minutes, coalesce(n_events, 0) AS n_events, "
        "coalesce(n_abnormal, 0) AS n_abnormal, coalesce(n_severe, 0) AS n_severe, coalesce(n_whirl, 0) AS n_whirl, "
        "coalesce(n_convulsion, 0) AS n_convulsion, coalesce(event_seconds, 0::DOUBLE) AS event_seconds, coalesce(stage_max, 0) AS stage_max, "
        "mean_speed, max_speed, mean_bend, max_bend, mean_likelihood, coalesce(tracking_qc_pass, TRUE) AS tracking_qc_pass "
        "FROM scaffold s LEFT JOIN logged l ON s.subject_id = l.subject_id AND s.t = l.t, median_minutes m",
    ),
    "rates": (
        ["filled"],
        "SELECT *, n_abnormal / session_minutes AS abnormal_rate, n_severe / session_minutes AS severe_rate, "
        "n_whirl / session_minutes AS whirl_rate, n_convulsion / session_minutes AS convulsion_rate, "
        "greatest(0::DOUBLE, least(1::DOUBLE, 1 - event_seconds / (session_minutes * 60))) AS rest_fraction FROM filled",
    ),
    "quantiles": (
        ["rates"],
        "SELECT " + ", ".join(
            f"CASE WHEN quantile_cont({c}, 0.9) > 0 THEN quantile_cont({c}, 0.9) ELSE 1::DOUBLE END AS q_{c}"
            for c in ("abnormal_rate", "severe_rate", "whirl_rate", "convulsion_rate")
        ) + " FROM rates",
    ),
    "behavior": (
        ["rates", "quantiles"],
        "SELECT r.*, round((abnormal_rate / q_abnormal_rate + severe_rate / q_severe_rate + whirl_rate / q_whirl_rate "
        "+ convulsion_rate / q_convulsion_rate + stage_max / 3.0::DOUBLE) / 5, 6) AS abnormality FROM rates r, quantiles q",
    ),
    "usable": (["sessions"], "SELECT * FROM sessions WHERE qc_pass"),
    "prefix": (
        ["usable"],
        "SELECT * EXCLUDE (place), CAST(t - 4 AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t) AS place FROM usable) WHERE t - place = 3",
    ),
    "picked": (
        ["outcomes"],
        "SELECT subject_id, arm, target, stratum, place <= CASE WHEN n >= 3 THEN greatest(1, least(n - 1, CAST(round_even(0.3::DOUBLE * n, 0) AS BIGINT))) ELSE 0 END AS is_test "
        "FROM (SELECT subject_id, arm, target, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|split|' || subject_id), subject_id) AS place, "
        "count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT *, arm || '__' || coalesce(CAST(target AS VARCHAR), 'missing') AS stratum FROM outcomes))",
    ),
    "assigned": (
        ["picked"],
        "SELECT r.subject_id, r.arm, r.target, CASE WHEN r.is_test <> (r.place <= abs(g.gap) AND ((g.gap > 0 AND NOT r.is_test) OR (g.gap < 0 AND r.is_test))) "
        "THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY arm, is_test ORDER BY md5('42|rebalance|' || subject_id), subject_id) AS place FROM picked) r "
        "JOIN (SELECT arm, CAST(round_even(0.3::DOUBLE * count(*), 0) AS BIGINT) - count(*) FILTER (WHERE is_test) AS gap FROM picked GROUP BY arm) g ON r.arm = g.arm",
    ),
    "train": (["assigned"], "SELECT subject_id FROM assigned WHERE split = 'train'"),
    "test": (["assigned"], "SELECT subject_id FROM assigned WHERE split = 'test'"),
    "folds": (
        ["assigned"],
        "SELECT subject_id, arm, CAST((row_number() OVER (PARTITION BY arm ORDER BY md5('42|fold|' || subject_id), subject_id) - 1) % 3 AS INTEGER) AS fold "
        "FROM assigned WHERE split = 'train'",
    ),
    "scaler": (
        ["prefix", "train"],
        "SELECT " + ", ".join(f"median(ln(1 + {f})) AS c{d}" for d, f in enumerate(FEATURES)) + ", " + ", ".join(
            f"CASE WHEN quantile_cont(ln(1 + {f}), 0.75) - quantile_cont(ln(1 + {f}), 0.25) < 1e-9 THEN 1::DOUBLE "
            f"ELSE quantile_cont(ln(1 + {f}), 0.75) - quantile_cont(ln(1 + {f}), 0.25) END AS s{d}"
            for d, f in enumerate(FEATURES)
        ) + " FROM prefix WHERE subject_id IN (SELECT subject_id FROM train)",
    ),
    "scaled": (
        ["prefix", "scaler"],
        "SELECT p.*, " + ", ".join(f"(ln(1 + {f}) - c{d}) / s{d} AS x{d}" for d, f in enumerate(FEATURES)) + " FROM prefix p, scaler",
    ),
    **_model_tables(FIXED_MODEL),
    **_model_tables(FIXED_TWO_STATE, "two_"),
    **_inference(),
    **_inference("two_"),
    "scored": (
        ["decoded", "posterior", "scaled"],
        "SELECT s.subject_id, s.arm, s.t, s.pos, s.pressure, s.dose, d.severity AS state, q.expected_state, q.p0, q.p1, q.p2 "
        "FROM scaled s JOIN decoded d ON s.subject_id = d.subject_id AND s.pos = d.pos "
        "JOIN (SELECT subject_id, pos, sum(severity * p) AS expected_state, sum(p) FILTER (WHERE severity = 0) AS p0, "
        "sum(p) FILTER (WHERE severity = 1) AS p1, sum(p) FILTER (WHERE severity = 2) AS p2 FROM posterior GROUP BY subject_id, pos) q "
        "ON s.subject_id = q.subject_id AND s.pos = q.pos",
    ),
    "test_scored": (["scored", "test"], "SELECT * FROM scored WHERE subject_id IN (SELECT subject_id FROM test)"),
    "powers": (
        ["steps", "states"],
        "SELECT 1 AS n, mi.severity AS i, a.j AS raw_j, a.p FROM steps a JOIN states mi ON a.i = mi.k "
        "UNION ALL SELECT 2, mi.severity, b.j, sum(a.p * b.p) FROM steps a JOIN steps b ON a.j = b.i JOIN states mi ON a.i = mi.k GROUP BY mi.severity, b.j",
    ),
    "last_filtered": (
        ["posterior", "scaled"],
        "SELECT p.subject_id, p.severity, p.p, s.t AS last_t, s.arm FROM posterior p JOIN scaled s ON p.subject_id = s.subject_id AND p.pos = s.pos "
        "JOIN (SELECT subject_id, max(t) AS t FROM scaled WHERE t <= 5 GROUP BY subject_id) l ON l.subject_id = s.subject_id AND l.t = s.t",
    ),
    "carried": (
        ["last_filtered", "powers", "states"],
        "SELECT l.subject_id, m.severity, sum(l.p * a.p) AS p FROM last_filtered l JOIN powers a ON a.n = 6 - l.last_t AND a.i = l.severity "
        "JOIN states m ON m.k = a.raw_j GROUP BY l.subject_id, m.severity",
    ),
    "forecasts": (
        ["last_filtered", "carried", "outcomes", "test"],
        "SELECT l.subject_id, l.arm, l.last_t, 6 - l.last_t AS steps, l.p AS current_risk, c.p AS risk, o.target, o.batch, o.dose "
        "FROM last_filtered l JOIN carried c ON c.subject_id = l.subject_id AND c.severity = 2 "
        "JOIN outcomes o ON o.subject_id = l.subject_id AND o.target IS NOT NULL "
        "WHERE l.severity = 2 AND l.subject_id IN (SELECT subject_id FROM test)",
    ),
    "state_index": (
        ["decoded"],
        "SELECT subject_id, avg(severity) AS mean_state_index, CAST(count(*) AS INTEGER) AS n_sessions FROM decoded GROUP BY subject_id",
    ),
    "ranked_index": (
        ["state_index", "outcomes"],
        "SELECT i.subject_id, i.mean_state_index AS y, CAST(substr(o.arm, 2) AS INTEGER) AS x, o.arm FROM state_index i JOIN outcomes o USING (subject_id)",
    ),
    "merged_behavior": (
        ["forecasts", "behavior"],
        "SELECT f.*, b.abnormality, b.mean_speed, b.rest_fraction, b.whirl_rate, b.stage_max FROM forecasts f JOIN behavior b USING (subject_id) WHERE b.t = 6 AND b.tracking_qc_pass",
    ),
}


def mid_rank(value: str, partition: str = "") -> str:
    """Average rank as a window expression."""
    over = f"PARTITION BY {partition} " if partition else ""
    peers = f"PARTITION BY {partition}, {value}" if partition else f"PARTITION BY {value}"
    return f"(rank() OVER ({over}ORDER BY {value}) + (count(*) OVER ({peers}) - 1) / 2.0::DOUBLE)"


#: Levels of the draw tree in SQL: up to 2^30 distinct values.
TREE_LEVELS = 30


_WHOLE = "18446744073709551616::UHUGEINT"


def mixed(source: str, column: str) -> str:
    """``source`` with its unsigned ``column`` mixed as ``mix64`` does."""
    for shift, factor in MIX64:
        source = f"SELECT * REPLACE ((xor({column}, {column} >> {shift})::UHUGEINT * {factor}::UHUGEINT % {_WHOLE})::UBIGINT AS {column}) FROM ({source})"
    return source


def _uniform(source: str, draw: int) -> str:
    """``source`` with a column ``u``: the uniform number of (key, level, node, draw)."""
    number = f"((((node << {LEVEL_BITS}) | level) << {DRAW_BITS}) | {draw})::UHUGEINT"
    text = mixed(f"SELECT *, ((key::UHUGEINT + {number}) % {_WHOLE})::UBIGINT AS h FROM ({source})", "h")
    return f"SELECT * EXCLUDE (h), ((h >> 11)::DOUBLE + 0.5) * 1.1102230246251565e-16 AS u FROM ({text})"


def _inverted(source: str, low: str, high: str, log_weight: str, sure: str, name: str, keep: list[str]) -> str:
    """``source`` with a column ``name``: the least k whose cumulated probability exceeds ``u``, or ``sure`` where that is not null."""
    names = ", ".join(keep)
    listed = f"SELECT *, {sure} AS sure, unnest(CASE WHEN {sure} IS NULL THEN range({low}, {high} + 1) ELSE [0] END) AS k FROM ({source})"
    weighed = f"SELECT *, CASE WHEN sure IS NULL THEN exp({log_weight}) ELSE 1 END AS weight FROM ({listed})"
    summed = f"SELECT *, sum(weight) OVER (PARTITION BY iter, node ORDER BY k) AS below, sum(weight) OVER (PARTITION BY iter, node) AS whole, min(k) OVER (PARTITION BY iter, node) AS least FROM ({weighed})"
    return f"SELECT {names}, CASE WHEN max(sure) IS NOT NULL THEN max(sure) ELSE max(least) + count(*) FILTER (below <= u * whole) END AS {name} FROM ({summed}) GROUP BY {names}"


def centre_tables(seed: int, restarts: int, states: int, rounds: int) -> dict:
    """``centres(restart, k, x0..x3)``: rows that win the race by distance, then Lloyd steps, over the training rows of ``scaled``."""
    columns = ", ".join(f"x{d}" for d in range(4))
    keys = ", ".join(f"({r}, {step}, {int(centre_key(seed, r, step)[0])}::UBIGINT)" for r in range(restarts) for step in range(states))
    rows = mixed("SELECT subject_id, pos, x0, x1, x2, x3, ('0x' || md5(subject_id)[1:16])::UBIGINT AS h FROM scaled WHERE subject_id IN (SELECT subject_id FROM train)", "h")
    drawn = mixed(f"SELECT r.* EXCLUDE (h), restart, step, ((((h::UHUGEINT + pos::UHUGEINT) % {_WHOLE}) + key::UHUGEINT) % {_WHOLE})::UBIGINT AS u FROM ({rows}) r, (VALUES {keys}) AS v(restart, step, key)", "u")
    apart = "(" + " + ".join(f"(r.x{d} - c.x{d}) * (r.x{d} - c.x{d})" for d in range(4)) + ")"
    tables = {"race": (["scaled", "train"], f"SELECT *, -ln(((u >> 11)::DOUBLE + 0.5) * 1.1102230246251565e-16) AS wait FROM ({drawn})")}
    won = ", ".join(f"arg_min(r.x{d}, r.wait) AS x{d}" for d in range(4))
    tables["picked0"] = (["race"], f"SELECT restart, 0 AS k, {won} FROM race r WHERE step = 0 GROUP BY restart")
    for step in range(1, states):
        near = f"SELECT r.restart, r.subject_id, r.pos, r.x0, r.x1, r.x2, r.x3, any_value(r.wait) / greatest(min({apart}), 1e-300) AS wait FROM race r JOIN picked{step - 1} c USING (restart) WHERE r.step = {step} GROUP BY ALL"
        near = near.replace("SELECT r.restart", "SELECT restart").replace("GROUP BY ALL", "GROUP BY restart, r.subject_id, r.pos, r.x0, r.x1, r.x2, r.x3")
        tables[f"picked{step}"] = (["race", f"picked{step - 1}"], f"SELECT * FROM picked{step - 1} UNION ALL SELECT restart, {step}, {won} FROM ({near}) r GROUP BY restart")
    last = f"picked{states - 1}"
    for i in range(rounds):
        label = f"SELECT restart, r.subject_id, r.pos, arg_min(c.k, ({apart}, c.k)) AS k FROM race r JOIN {last} c USING (restart) WHERE r.step = 0 GROUP BY restart, r.subject_id, r.pos"
        means = ", ".join(f"avg(r.x{d}) AS x{d}" for d in range(4))
        moved = f"SELECT l.restart, l.k, {means} FROM ({label}) l JOIN race r ON r.restart = l.restart AND r.subject_id = l.subject_id AND r.pos = l.pos AND r.step = 0 GROUP BY l.restart, l.k"
        kept = ", ".join(f"coalesce(m.x{d}, c.x{d}) AS x{d}" for d in range(4))
        tables[f"lloyd{i}"] = ([last], f"SELECT c.restart, c.k, {kept} FROM {last} c LEFT JOIN ({moved}) m USING (restart, k)")
        last = f"lloyd{i}"
    tables["centres"] = ([last], f"SELECT restart, k, {columns} FROM {last}")
    return tables


def tree_tables(kind: str, seed: int, iterations: int, classes: int, cells: str = "tree_cells", suffix: str = "") -> dict:
    """``drawn{suffix}(iter, place, class, n)`` from ``tree_cells(value_no, class, size)``: draws or labels that the tree gives to each cell."""
    bits = (classes - 1).bit_length() if kind == "bootstrap" else 0
    place = f"(value_no << {bits}) | class" if bits else "value_no"
    keys = ", ".join(f"({i}, {int(k)}::UBIGINT)" for i, k in enumerate(iteration_keys(seed, np.arange(iterations))))
    tables = {
        f"tree_sizes{suffix}": ([cells], f"SELECT level, p >> level AS node, sum(size)::BIGINT AS size FROM (SELECT {place} AS p, sum(size) AS size FROM {cells} GROUP BY ALL), range({TREE_LEVELS + bits + 1}) AS l(level) GROUP BY ALL"),
        f"tree_halves{suffix}": (
            [f"tree_sizes{suffix}"],
            f"SELECT w.level, w.node, coalesce(a.size, 0) AS lsize, coalesce(b.size, 0) AS rsize FROM tree_sizes{suffix} w LEFT JOIN tree_sizes{suffix} a ON a.level = w.level - 1 AND a.node = 2 * w.node LEFT JOIN tree_sizes{suffix} b ON b.level = w.level - 1 AND b.node = 2 * w.node + 1 WHERE w.level > 0",
        ),
        f"tree_keys{suffix}": ([], f"SELECT * FROM (VALUES {keys}) AS v(iter, key)"),
    }
    if kind == "bootstrap":
        state = ["n"]
        base = f"SELECT iter, key, {TREE_LEVELS + bits} AS level, 0::BIGINT AS node, (SELECT sum(size)::BIGINT FROM {cells}) AS n FROM tree_keys{suffix}"
        keep = ["iter", "key", "level", "node", "n"]
        joined = f"SELECT t.*, lsize, rsize FROM tree_walk{suffix} t JOIN tree_halves{suffix} USING (level, node) WHERE level > 0"
        weight = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(lsize / (lsize + rsize)::DOUBLE) + (n - k) * ln(rsize / (lsize + rsize)::DOUBLE)"
        split = _inverted(_uniform(joined, 0), "0", "n", weight, "CASE WHEN rsize = 0 THEN n WHEN lsize = 0 THEN 0 END", "n_left", keep)
        children = f"SELECT iter, key, level - 1 AS level, 2 * node + side AS node, CASE side WHEN 0 THEN n_left ELSE n - n_left END AS n FROM ({split}), (VALUES (0), (1)) AS s(side)"
        step = f"SELECT * FROM ({children}) WHERE n > 0"
    else:
        state = [f"l{c}" for c in range(classes)]
        sums = ", ".join(f"sum(size) FILTER (class = {c})::BIGINT AS l{c}" for c in range(classes))
        base = f"SELECT iter, key, {TREE_LEVELS} AS level, 0::BIGINT AS node, {', '.join(f'coalesce({x}, 0) AS {x}' for x in state)} FROM tree_keys{suffix}, (SELECT {sums} FROM {cells})"
        text = f"SELECT t.*, lsize AS wanted, {' + '.join(state)} AS rest FROM tree_walk{suffix} t JOIN tree_halves{suffix} USING (level, node) WHERE level > 0"
        keep = ["iter", "key", "level", "node", *state]
        for c in range(classes - 1):
            text = f"SELECT * REPLACE (rest - l{c} AS rest) FROM ({text})"
            weight = (
                f"lgamma(l{c} + 1) - lgamma(k + 1) - lgamma(l{c} - k + 1) + lgamma(rest + 1) - lgamma(wanted - k + 1) - lgamma(rest - wanted + k + 1)"
                f" - lgamma(l{c} + rest + 1) + lgamma(wanted + 1) + lgamma(l{c} + rest - wanted + 1)"
            )
            sure = f"CASE WHEN l{c} = 0 OR wanted = 0 THEN 0 WHEN rest = 0 THEN wanted WHEN wanted = l{c} + rest THEN l{c} END"
            have = [*keep, *[f"d{b}" for b in range(c)], "wanted", "rest"]
            text = _inverted(_uniform(text, c), f"greatest(0, wanted - rest)", f"least(l{c}, wanted)", weight, sure, f"d{c}", have)
            text = f"SELECT * REPLACE (wanted - d{c} AS wanted) FROM ({text})"
        lefts = [*[f"d{c}" for c in range(classes - 1)], "wanted"]
        sides = ", ".join(f"CASE side WHEN 0 THEN {d} ELSE {x} - {d} END AS {x}" for d, x in zip(lefts, state))
        children = f"SELECT iter, key, level - 1 AS level, 2 * node + side AS node, {sides} FROM ({text}), (VALUES (0), (1)) AS s(side)"
        step = f"SELECT * FROM ({children}) WHERE {' + '.join(state)} > 0"
    tables[f"tree_walk{suffix}"] = ([f"tree_halves{suffix}", f"tree_keys{suffix}", cells], f"{base} UNION ALL {step}")
    if kind == "bootstrap":
        drawn = f"SELECT iter, node >> {bits} AS value_no, node & {(1 << bits) - 1} AS class, n FROM tree_walk{suffix} WHERE level = 0"
    else:
        drawn = f"SELECT iter, node AS value_no, class, n FROM (SELECT iter, node, unnest([{', '.join(state)}]) AS n, unnest(range({classes})) AS class FROM tree_walk{suffix} WHERE level = 0) WHERE n > 0"
    tables[f"tree_drawn{suffix}"] = ([f"tree_walk{suffix}"], drawn)
    return tables


def compose(uses: Sequence[str], select: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``WITH`` the fragments that ``uses`` needs, in dependency order, before ``select``."""
    known = {**FRAGMENTS, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in known[name][0]:
            visit(needed)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return select
    # every fragment is read several times, so each is computed once
    body = ", ".join(f"{name} AS {'' if name.startswith('tree_walk') else 'MATERIALIZED '}({known[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {body} {select}"
