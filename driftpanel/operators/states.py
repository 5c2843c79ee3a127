"""Severity-ordered states: relabelling, scored sessions, dynamics, and causal forecasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.functions.columns import arm_rank, expected_index, propagate
from driftpanel.functions.joins import by_key
from driftpanel.operators.hmm import HmmModel, infer
from driftpanel.operators.sequences import build_sequences, contiguous_prefix, scale_rows
from driftpanel.spec import FeatureSpec, PanelSpec


def severity_order(model: HmmModel, features: FeatureSpec) -> np.ndarray:
    """Raw states from mild to severe, by mean of rising minus mean of falling features."""
    rising = [features.columns.index(f) for f in features.rising]
    falling = [features.columns.index(f) for f in features.falling]
    score = model.means[:, rising].mean(axis=1)
    if falling:
        score = score - model.means[:, falling].mean(axis=1)
    return np.argsort(score, kind="stable")


def severity_table(state_means: DataFrame, features: FeatureSpec) -> DataFrame:
    """The same order for a table ``state, feature, mean``: adds ``score`` and ``severity``.

    The table holds one row per state and feature of a model.
    """
    rising = F.avg(F.when(F.col("feature").isin(list(features.rising)), F.col("mean")))
    falling = F.avg(F.when(F.col("feature").isin(list(features.falling)), F.col("mean"))) if features.falling else F.lit(0.0)
    scores = state_means.groupBy("state").agg((rising - falling).alias("score"))
    by_score = Window.partitionBy(F.lit(1)).orderBy("score", "state")
    return scores.withColumn("severity", (F.row_number().over(by_score) - 1).cast("int"))


def model_sequences(sessions: DataFrame, scaler: DataFrame, spec: PanelSpec, cutoff: int | None = None) -> DataFrame:
    """Scaled gap-free sequences with the session columns that scoring needs."""
    rows = scale_rows(contiguous_prefix(sessions, spec, cutoff), scaler, spec)
    return build_sequences(rows, spec, carry=("arm", "pressure", "dose"))


def decode(sequences: DataFrame, model: HmmModel, order) -> DataFrame:
    """Severity-ordered path and causal posterior of each subject; scores, index, and forecast all read it."""
    return infer(sequences, model, order=order)


def score_sessions(decoded: DataFrame) -> DataFrame:
    """One row per session: severity state, posterior ``p_state``, expected state."""
    zipped = F.arrays_zip("ts", "arm", "pressure", "dose", "path", "posterior")
    rows = decoded.select("subject_id", F.posexplode(zipped).alias("position", "_s"))
    return rows.select(
        "subject_id",
        F.col("_s.arm").alias("arm"),
        F.col("_s.ts").alias("t"),
        "position",
        F.col("_s.pressure").alias("pressure"),
        F.col("_s.dose").alias("dose"),
        F.col("_s.path").alias("state"),
        expected_index(F.col("_s.posterior")).alias("expected_state"),
        F.col("_s.posterior").alias("p_state"),
    )


def state_columns(n_states: int, posterior: str = "p_state") -> list[Column]:
    return [F.get(posterior, F.lit(k)).alias(f"p_state_{k}") for k in range(n_states)]


def occupancy(scored: DataFrame, n_states: int) -> DataFrame:
    """Sessions, mean expected state, and share in each state, by arm and period."""
    shares = [F.avg((F.col("state") == k).cast("double")).alias(f"fraction_state_{k}") for k in range(n_states)]
    return scored.groupBy("arm", "t").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg("expected_state").alias("mean_expected_state"), *shares
    )


def occupancy_text(occupied: DataFrame, state: int, t: int) -> DataFrame:
    """``"a0 12%, a1 30%"`` for one state in one period; an occupancy table has one row per arm."""
    percent = F.bround(100 * F.col(f"fraction_state_{state}")).cast("int")
    part = F.format_string("%s %d%%", F.col("arm"), percent)
    return occupied.where(F.col("t") == t).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("arm", part.alias("text")))), lambda s: s["text"]), ", ").alias(
            "occupancy"
        )
    )


def state_changes(scored: DataFrame) -> DataFrame:
    """Change of state since the previous session of the subject; first sessions have none."""
    previous = F.lag("state").over(Window.partitionBy("subject_id").orderBy("t"))
    return scored.withColumn("change", F.col("state") - previous).where(F.col("change").isNotNull())


def arm_table(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The declared arms, one row each."""
    return df.sparkSession.createDataFrame([(a,) for a in spec.arms], "arm string")


def transition_summary(scored: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of worsening, recovering, and stable steps; every arm has a row, NULL without steps."""
    counts = state_changes(scored).groupBy("arm").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("change") > 0).alias("_up"),
        F.count_if(F.col("change") < 0).alias("_down"),
        F.count_if(F.col("change") == 0).alias("_same"),
    )
    return F.broadcast(arm_table(scored, spec)).join(counts, "arm", "left").select(
        "arm",
        F.coalesce("_n", F.lit(0)).alias("n_transitions"),
        F.try_divide("_up", "_n").alias("worsening_fraction"),
        F.try_divide("_down", "_n").alias("recovery_fraction"),
        F.try_divide("_same", "_n").alias("stable_fraction"),
    )


def by_arm_and_period(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.orderBy(arm_rank(spec), "t")


def state_index(decoded: DataFrame) -> DataFrame:
    """Mean severity state and number of sessions of each subject."""
    total = F.aggregate("path", F.lit(0), lambda a, s: a + s)
    return decoded.select(
        "subject_id", (total / F.size("path")).alias("mean_state_index"), F.size("path").alias("n_sessions")
    )


def matrix_literal(matrix: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])


def forecast(decoded: DataFrame, outcomes: DataFrame, model: HmmModel, order, spec: PanelSpec) -> DataFrame:
    """Causal forecast per subject with a known target.

    The posterior is causal, so its entry at the last session up to the cutoff has seen nothing
    later. It is carried to the target period by the ordered transition matrix; the risk is the
    most severe state.
    """
    order = [int(o) for o in order]
    k = len(order)
    matrix = matrix_literal(model.trans[np.ix_(order, order)])
    # sequences have no gaps, so periods up to the cutoff are the first entries
    last = F.least(F.size("ts"), F.lit(spec.t_cutoff - spec.t0 + 1)) - 1
    seen = decoded.select(
        "subject_id", F.get("arm", last).alias("arm"), F.get("ts", last).alias("last_t"), F.get("posterior", last).alias("_p")
    )
    known = outcomes.where(F.col("target").isNotNull()).select("subject_id", "target", "batch", "dose")
    steps = F.lit(spec.t_target) - F.col("last_t")
    return seen.join(by_key(known), "subject_id").select(
        "subject_id",
        "arm",
        "last_t",
        steps.alias("steps"),
        F.get("_p", F.lit(k - 1)).alias("current_risk"),
        F.get(propagate(F.col("_p"), matrix, steps, k), F.lit(k - 1)).alias("risk"),
        "target",
        "batch",
        "dose",
    )


def parameter_tables(df: DataFrame, model: HmmModel, order, spec: PanelSpec) -> dict[str, DataFrame]:
    """Start, transition, and emission tables in severity order; K*K and K*D rows."""
    order = [int(o) for o in order]
    start, trans, means = model.start[order], model.trans[np.ix_(order, order)], model.means[order]
    create = df.sparkSession.createDataFrame
    k = range(len(order))
    return {
        "start": create([(i, float(start[i])) for i in k], "state int, p double"),
        "transition": create([(i, j, float(trans[i, j])) for i in k for j in k], "from_state int, to_state int, p double"),
        "emission": create(
            [(i, f, float(means[i, d])) for i in k for d, f in enumerate(spec.features.columns)],
            "state int, feature string, mean double",
        ),
    }


def transition_wide(transition: DataFrame, n_states: int) -> DataFrame:
    cells = [F.max(F.when(F.col("to_state") == j, F.col("p"))).alias(f"to_state_{j}") for j in range(n_states)]
    return transition.groupBy(F.concat(F.lit("from_state_"), F.col("from_state").cast("string")).alias("from_state")).agg(*cells)
