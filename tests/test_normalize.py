from __future__ import annotations

from pyspark.sql import functions as F

from panel_data import SPEC, make_study
from driftpanel.operators import normalize as norm

EVENT_SCHEMA = (
    "subject_id string, t int, qualifies boolean, stage int, behavior_class string, session_duration_s double, event_duration_s double, "
    "mean_velocity double, peak_velocity double, rms_bend double, max_bend double, likelihood double, tracking_qc_pass boolean"
)


def event(subject, t, qualifies=False, stage=0, cls="swim", seconds=10.0, qc=True):
    return (subject, t, qualifies, stage, cls, 300.0, seconds, 1.0, 2.0, 3.0, 4.0, 0.9, qc)


def study(spark):
    # S0001 never seen at 6, S0002 only in the log at 6, S0003 normal swimming at 6, S0004 a qualifying event
    sessions, _, _ = make_study(spark, periods_of={"S0001": (4, 5), "S0002": (4, 5)})
    log = spark.createDataFrame(
        [
            event("S0001", 5, True, 3, "whirlpool"),
            event("S0002", 6),
            event("S0003", 6),
            event("S0004", 6, True, 2, "whirlpool"),
            event("S0004", 6, False, 1, "convulsion_posture_loss", qc=False),
            event("S0005", 9, True, 3),
        ],
        EVENT_SCHEMA,
    )
    raw = sessions.select("subject_id").distinct().select("subject_id", F.lit(0).alias("became_positive"))
    return sessions, raw, log


def test_unknown_target_is_not_negative(spark):
    outcomes = norm.normalize_outcomes(*study(spark), SPEC)
    target = {r.subject_id: r.target for r in outcomes.collect()}
    assert target["S0001"] is None
    assert target["S0002"] == 0 and target["S0003"] == 0
    assert target["S0004"] == 1
    survived = {r.subject_id: r.survived for r in outcomes.collect()}
    assert not survived["S0002"] and survived["S0003"]


def test_silent_sessions_become_zero_rows_and_extra_periods_are_dropped(spark):
    sessions, _, log = study(spark)
    behavior = norm.normalize_behavior(sessions, log)
    assert behavior.count() == sessions.count()
    assert behavior.where("t = 9").count() == 0
    silent = behavior.where("subject_id = 'S0006' and t = 6").first()
    assert silent.n_events == 0 and silent.abnormal_rate == 0.0 and silent.rest_fraction == 1.0
    assert silent.session_minutes == 5.0 and silent.tracking_qc_pass and silent.mean_speed is None
    busy = behavior.where("subject_id = 'S0004' and t = 6").first()
    assert (busy.n_events, busy.n_abnormal, busy.n_severe, busy.n_whirl, busy.n_convulsion) == (2, 2, 1, 1, 1)
    assert not busy.tracking_qc_pass and abs(busy.rest_fraction - (1 - 20 / 300)) < 1e-12


def test_manifest_counts_add_up(spark):
    manifest = norm.cohort_manifest(norm.normalize_outcomes(*study(spark), SPEC)).collect()
    whole = next(r for r in manifest if r.arm is None)
    assert whole.n_subjects == sum(r.n_subjects for r in manifest if r.arm is not None) == 24
    assert whole.n_positive + whole.n_negative + whole.n_unresolved == 24


def test_labels_take_the_first_known_value(spark):
    rows = [("A", "x", None, "c", "p", 1, 1.0, 2.0, 4), ("A", "x", 5, "c", "p", 1, 3.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "subject_id string, arm string, batch int, clutch string, plate string, n_drops int, pressure double, dose double, t int")
    row = norm.subject_metadata(df).first()
    assert (row.batch, row.pressure, row.dose, row.last_t, row.n_sessions) == (5, 2.0, 2.0, 5, 2)
