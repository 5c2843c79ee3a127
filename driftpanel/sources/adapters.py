"""Deterministic panel studies shaped from event and order tables.

Each adapter returns the three raw study tables: sessions, outcomes, event log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpanel.functions.columns import qc_rule
from driftpanel.functions.joins import by_key
from driftpanel.spec import PanelSpec

EVENT_SPEC = PanelSpec()
ORDER_SPEC = PanelSpec(arms=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))


@dataclass(frozen=True)
class RawStudy:
    sessions: DataFrame
    outcomes: DataFrame
    event_log: DataFrame


def _feature_aggregates(value: Column, is_burst: Column, per: float) -> list[Column]:
    return [
        F.var_pop(value).alias("f_var"),
        (F.max(value) / (1 + F.avg(value))).alias("f_peak"),
        (F.count_if(is_burst) / F.lit(per)).alias("f_rate"),
        F.avg(F.pow(value, F.lit(4.0))).alias("f_pow4"),
    ]


def event_study(spark: SparkSession, sf_dir: str, spec: PanelSpec = EVENT_SPEC) -> RawStudy:
    """Even event ids are the measured signal, odd ones the scored event log.

    Periods are ten days long, counted from 2024-01-01; every event is kept, also outside the
    periods of ``spec``, where the quality rules count it.
    """
    events = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select("event_id", "ts", "user_id", "event_type", "value")
        .withColumn("t", F.expr(f"cast(floor(datediff(to_date(ts), DATE'2024-01-01') / 10) as int) + {spec.t0}"))
    )
    user = F.col("user_id")
    arm = F.concat(F.lit("a"), (user % 4).cast("string"))
    sessions = (
        events.where(F.col("event_id") % 2 == 0)
        .groupBy("user_id", "t")
        .agg(
            (F.count_if(F.col("event_type") == "view") * 100.0 / F.count(F.lit(1))).alias("shift"),
            F.min("ts").alias("started_at"),
            *_feature_aggregates(F.col("value"), F.col("event_type") == "error", 2.0),
        )
        .select(
            user.cast("string").alias("subject_id"),
            arm.alias("arm"),
            (user % 3).cast("int").alias("batch"),
            F.concat(F.lit("c"), (user % 5).cast("string")).alias("clutch"),
            F.concat(F.lit("p"), (user % 7).cast("string")).alias("plate"),
            F.lit(spec.baseline_t).alias("baseline_t"),
            "t",
            (user % 4).cast("int").alias("n_drops"),
            (90.0 * (user % 4) + F.col("t")).alias("pressure"),
            (100.0 * (user % 4) + user % 10).alias("dose"),
            F.lit(0.05).alias("noise"),
            "shift",
            "started_at",
            *spec.features.columns,
        )
        .withColumn("qc_pass", qc_rule(spec))
    )
    stage = (
        F.when(F.col("event_type") == "error", 3)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 1)
        .otherwise(0)
    )
    behavior_class = (
        F.when(F.col("event_type") == "error", "convulsion_posture_loss")
        .when(F.col("event_type") == "purchase", "whirlpool")
        .otherwise("swim")
    )
    event_log = events.where(F.col("event_id") % 2 == 1).select(
        user.cast("string").alias("subject_id"),
        "t",
        ((F.col("event_type") == "error") & (F.col("value") >= 20)).alias("qualifies"),
        stage.alias("stage"),
        behavior_class.alias("behavior_class"),
        F.lit(300.0).alias("session_duration_s"),
        F.col("value").alias("event_duration_s"),
        (F.col("value") / 10).alias("mean_velocity"),
        (F.col("value") / 5).alias("peak_velocity"),
        (F.col("value") / 4).alias("rms_bend"),
        (F.col("value") / 2).alias("max_bend"),
        (0.5 + (F.col("event_id") % 50) / 100.0).alias("likelihood"),
        (F.col("event_id") % 20 != 1).alias("tracking_qc_pass"),
    )
    outcomes = events.select("user_id").distinct().select(
        user.cast("string").alias("subject_id"),
        (user % 2).cast("int").alias("became_positive"),
        F.lit(None).cast("double").alias("first_event_hours"),
    )
    return RawStudy(sessions, outcomes, event_log)


def order_study(spark: SparkSession, sf_dir: str, spec: PanelSpec = ORDER_SPEC) -> RawStudy:
    """Customers are subjects, spans of three order years from 1995 are periods, line items are the signal.

    Lines shipped under return flag R form the event log; the others form the sessions.
    """
    orders = (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .withColumn("t", F.floor((F.year("o_orderdate") - 1995) / 3).cast("int") + spec.t0)
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    facts = orders.join(by_key(lines), orders.o_orderkey == lines.l_orderkey).withColumn(
        "value", F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000
    )
    yearly = (
        facts.where(F.col("l_returnflag") != "R")
        .groupBy("o_custkey", "t")
        .agg(
            (F.count_if(F.col("l_discount") > 0.08) * 100.0 / F.count(F.lit(1))).alias("shift"),
            F.min("o_orderdate").alias("started_at"),
            *_feature_aggregates(F.col("value"), F.col("l_quantity") >= 45, 10.0),
        )
    )
    subject = F.col("o_custkey")
    rank = F.create_map(*[F.lit(v) for i, a in enumerate(spec.arms) for v in (a, i)])
    sessions = (
        yearly.join(by_key(customers), subject == F.col("c_custkey"))
        .withColumn("rank", F.try_element_at(rank, F.col("c_mktsegment")))
        .select(
            subject.cast("string").alias("subject_id"),
            F.col("c_mktsegment").alias("arm"),
            (subject % 3).cast("int").alias("batch"),
            F.concat(F.lit("c"), (subject % 7).cast("string")).alias("clutch"),
            F.concat(F.lit("p"), (subject % 11).cast("string")).alias("plate"),
            F.lit(spec.baseline_t).alias("baseline_t"),
            "t",
            F.col("rank").alias("n_drops"),
            (90.0 * F.col("rank") + F.col("t")).alias("pressure"),
            (100.0 * F.col("rank") + subject % 10).alias("dose"),
            F.lit(0.05).alias("noise"),
            "shift",
            "started_at",
            *spec.features.columns,
        )
        .withColumn("qc_pass", qc_rule(spec))
    )
    stage = (
        F.when(F.col("l_quantity") >= 40, 3).when(F.col("l_quantity") >= 25, 2).when(F.col("l_quantity") >= 10, 1).otherwise(0)
    )
    event_log = facts.where(F.col("l_returnflag") == "R").select(
        subject.cast("string").alias("subject_id"),
        "t",
        ((F.col("l_quantity") >= 40) & (F.col("value") >= 20)).alias("qualifies"),
        stage.alias("stage"),
        F.when(F.col("l_quantity") >= 40, "convulsion_posture_loss")
        .when(F.col("l_quantity") >= 25, "whirlpool")
        .otherwise("swim")
        .alias("behavior_class"),
        F.lit(300.0).alias("session_duration_s"),
        F.col("value").alias("event_duration_s"),
        (F.col("value") / 10).alias("mean_velocity"),
        (F.col("value") / 5).alias("peak_velocity"),
        (F.col("value") / 4).alias("rms_bend"),
        (F.col("value") / 2).alias("max_bend"),
        (0.5 + F.col("l_discount")).alias("likelihood"),
        (F.col("l_linenumber") != 7).alias("tracking_qc_pass"),
    )
    outcomes = orders.select("o_custkey").distinct().select(
        subject.cast("string").alias("subject_id"),
        (subject % 2).cast("int").alias("became_positive"),
        F.lit(None).cast("double").alias("first_event_hours"),
    )
    return RawStudy(sessions, outcomes, event_log)
