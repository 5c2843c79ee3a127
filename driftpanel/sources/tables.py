"""Readers with declared schemas for raw and normalised study tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftpanel.spec import PanelSpec

_STRING, _INT, _LONG, _DOUBLE, _BOOL, _TIME = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

RAW_SESSION_FIELDS = {
    "subject_id": _STRING, "arm": _STRING, "batch": _INT, "clutch": _STRING, "plate": _STRING, "baseline_t": _INT,
    "t": _INT, "n_drops": _INT, "pressure": _DOUBLE, "dose": _DOUBLE, "noise": _DOUBLE, "shift": _DOUBLE,
    "started_at": _TIME, "qc_pass": _BOOL,
}
RAW_OUTCOME_FIELDS = {"subject_id": _STRING, "became_positive": _INT, "first_event_hours": _DOUBLE}
RAW_EVENT_FIELDS = {
    "subject_id": _STRING, "t": _INT, "qualifies": _BOOL, "stage": _INT, "behavior_class": _STRING,
    "session_duration_s": _DOUBLE, "event_duration_s": _DOUBLE, "mean_velocity": _DOUBLE, "peak_velocity": _DOUBLE,
    "rms_bend": _DOUBLE, "max_bend": _DOUBLE, "likelihood": _DOUBLE, "tracking_qc_pass": _BOOL,
}
OUTCOME_FIELDS = {
    "subject_id": _STRING, "arm": _STRING, "batch": _INT, "clutch": _STRING, "plate": _STRING, "n_drops": _INT,
    "pressure": _DOUBLE, "dose": _DOUBLE, "last_t": _INT, "n_sessions": _LONG, "became_positive": _INT,
    "first_event_hours": _DOUBLE, "target": _INT, "max_stage": _INT, "survived": _BOOL,
}
BEHAVIOR_FIELDS = {
    "subject_id": _STRING, "t": _INT, "arm": _STRING, "session_minutes": _DOUBLE, "n_events": _LONG,
    "n_abnormal": _LONG, "n_severe": _LONG, "n_whirl": _LONG, "n_convulsion": _LONG, "event_seconds": _DOUBLE,
    "stage_max": _INT, "mean_speed": _DOUBLE, "max_speed": _DOUBLE, "mean_bend": _DOUBLE, "max_bend": _DOUBLE,
    "mean_likelihood": _DOUBLE, "tracking_qc_pass": _BOOL, "abnormal_rate": _DOUBLE, "severe_rate": _DOUBLE,
    "whirl_rate": _DOUBLE, "convulsion_rate": _DOUBLE, "rest_fraction": _DOUBLE, "abnormality": _DOUBLE,
}


def schema(fields: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


def session_schema(spec: PanelSpec) -> T.StructType:
    return schema({**RAW_SESSION_FIELDS, **{c: _DOUBLE for c in spec.features.columns}})


def read_table(
    spark: SparkSession,
    path: str,
    columns: T.StructType,
    fmt: str = "parquet",
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read one table with a declared schema; ``rename`` maps source column names to study names.

    CSV files are matched to the schema by position of their header names.
    """
    source_of = {study: source for source, study in (rename or {}).items()}
    declared = T.StructType([T.StructField(source_of.get(f.name, f.name), f.dataType, True) for f in columns])
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        by_name = {f.name: f for f in declared}
        declared = T.StructType([by_name.get(h, T.StructField(h, _STRING, True)) for h in header])
        df = spark.read.option("header", True).option("enforceSchema", False).schema(declared).csv(path)
    else:
        df = spark.read.format(fmt).schema(declared).load(path)
    present = [f for f in columns if source_of.get(f.name, f.name) in df.columns]
    return df.select(*[F.col(source_of.get(f.name, f.name)).alias(f.name) for f in present])


def read_raw_study(
    spark: SparkSession, sessions: str, outcomes: str, event_log: str, spec: PanelSpec, fmt: str = "parquet", rename=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three raw tables: sessions, outcomes, event log."""
    return (
        read_table(spark, sessions, session_schema(spec), fmt, rename),
        read_table(spark, outcomes, schema(RAW_OUTCOME_FIELDS), fmt, rename),
        read_table(spark, event_log, schema(RAW_EVENT_FIELDS), fmt, rename),
    )


def read_study(spark: SparkSession, folder: str, spec: PanelSpec, fmt: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three normalised tables written by ``sinks.write_study``."""
    return (
        read_table(spark, f"{folder}/sessions", session_schema(spec), fmt),
        read_table(spark, f"{folder}/outcomes", schema(OUTCOME_FIELDS), fmt),
        read_table(spark, f"{folder}/behavior", schema(BEHAVIOR_FIELDS), fmt),
    )


def in_fixed_order(sessions: DataFrame, outcomes: DataFrame, behavior: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deterministic row order, for output only."""
    return sessions.orderBy("subject_id", "t"), outcomes.orderBy("subject_id"), behavior.orderBy("subject_id", "t")
