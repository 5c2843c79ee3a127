"""Writers: normalised tables, provenance manifest, result tables, metrics document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from driftpanel.operators.normalize import cohort_manifest
from driftpanel.spec import PanelSpec


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def manifest_document(sessions: DataFrame, outcomes: DataFrame, behavior: DataFrame, spec: PanelSpec) -> DataFrame:
    """One JSON row with cohort, session, and per-arm target counts."""
    counts = cohort_manifest(outcomes)
    per_arm = F.map_from_entries(
        F.sort_array(
            F.filter(
                F.collect_list(F.struct("arm", F.struct("n_subjects", "n_positive", "n_negative", "n_unresolved").alias("counts"))),
                lambda e: e["arm"].isNotNull(),
            )
        )
    )

    def overall(c: str):
        return F.max(F.when(F.col("arm").isNull(), F.col(c))).alias(c)

    cohort = counts.agg(*[overall(c) for c in ("n_subjects", "n_positive", "n_negative", "n_unresolved")], per_arm.alias("arms"))
    session_counts = sessions.agg(F.count(F.lit(1)).alias("n_sessions"), F.array_sort(F.collect_set("t")).alias("periods"))
    behavior_counts = behavior.agg(F.count(F.lit(1)).alias("n_behavior_sessions"))
    joined = cohort.crossJoin(F.broadcast(session_counts)).crossJoin(F.broadcast(behavior_counts))
    document = joined.withColumn("features", F.array(*[F.lit(c) for c in spec.features.columns]))
    return document.select(F.to_json(F.struct(*document.columns)).alias("value"))


def write_study(
    sessions: DataFrame, outcomes: DataFrame, behavior: DataFrame, folder: str, spec: PanelSpec, fmt: str = "parquet"
) -> None:
    for name, df in (("sessions", sessions), ("outcomes", outcomes), ("behavior", behavior)):
        write_table(df, f"{folder}/{name}", fmt)
    manifest_document(sessions, outcomes, behavior, spec).write.mode("overwrite").text(f"{folder}/manifest")


def metrics_document(metrics: DataFrame) -> DataFrame:
    """Rows ``section, scope, metric, value`` to one nested JSON row; the table has one row per metric."""
    by_scope = metrics.groupBy("section", "scope").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("values")
    )
    by_section = by_scope.groupBy("section").agg(
        F.map_from_entries(F.collect_list(F.struct("scope", "values"))).alias("scopes")
    )
    entries = F.map_from_entries(F.collect_list(F.struct("section", "scopes")))
    return by_section.agg(F.to_json(entries).alias("value"))


def write_results(tables: Mapping[str, DataFrame], metrics: DataFrame, folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/tables/{name}", fmt)
    metrics_document(metrics).write.mode("overwrite").text(f"{folder}/metrics")
