"""Gap-free prefixes, train-only scaling, and one array-valued sequence per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.functions.columns import log1p_features
from driftpanel.functions.joins import by_key
from driftpanel.functions.ranks import exact_percentiles, with_constants
from driftpanel.spec import PanelSpec


def qc_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("qc_pass"))


def contiguous_prefix(sessions: DataFrame, spec: PanelSpec, cutoff: int | None = None) -> DataFrame:
    """Rows from the first period on while periods are consecutive.

    A gap ends the prefix, and a subject without the first period has none. The window holds
    one subject's periods, so its size is bounded by the study.
    """
    if cutoff is not None:
        sessions = sessions.where(F.col("t") <= cutoff)
    by_subject = Window.partitionBy("subject_id").orderBy("t")
    numbered = sessions.withColumn("_place", F.row_number().over(by_subject))
    return numbered.where(F.col("t") - F.col("_place") == spec.t0 - 1).drop("_place")


def feature_quartiles(prefix: DataFrame, spec: PanelSpec, group: Sequence[str] = ()) -> DataFrame:
    columns = spec.features.columns
    return exact_percentiles(prefix.select(*group, *log1p_features(columns)), columns, [0.25, 0.5, 0.75], group)


def fit_scaler(prefix: DataFrame, spec: PanelSpec, group: Sequence[str] = ()) -> DataFrame:
    """``center`` (median) and ``scale`` (interquartile range, 1 when degenerate) of log1p features.

    ``prefix`` is the gap-free rows of the training subjects; one row per group.
    """

    def picked(feature: str, p: float) -> Column:
        chosen = F.max(F.when((F.col("feature") == feature) & (F.col("p") == p), F.col("value")))
        return F.coalesce(chosen, F.raise_error(F.lit("no training observations to scale by")).cast("double"))

    def spread(feature: str) -> Column:
        iqr = picked(feature, 0.75) - picked(feature, 0.25)
        return F.when(iqr < 1e-9, F.lit(1.0)).otherwise(iqr)

    features = spec.features.columns
    return feature_quartiles(prefix, spec, group).groupBy(*group).agg(
        F.array(*[picked(f, 0.5) for f in features]).alias("center"),
        F.array(*[spread(f) for f in features]).alias("scale"),
    )


def scale_rows(prefix: DataFrame, scaler: DataFrame, spec: PanelSpec) -> DataFrame:
    """Replace the features by their robust-scaled log1p values; ``scaler`` is one row."""
    scaled = {
        c: (F.log1p(F.col(c).cast("double")) - F.get("center", F.lit(i))) / F.get("scale", F.lit(i))
        for i, c in enumerate(spec.features.columns)
    }
    return with_constants(prefix, scaler).withColumns(scaled).drop("center", "scale")


def build_sequences(rows: DataFrame, spec: PanelSpec, carry: Sequence[str] = ("arm",)) -> DataFrame:
    """One row per subject: ``ts`` and ``xs`` in period order, with carried per-session columns.

    ``rows`` are gap-free prefix rows whose features are already transformed, so a list holds at
    most one entry per study period. ``carry`` columns become arrays aligned with ``ts``.
    """
    vector = F.array(*[F.col(c).cast("double") for c in spec.features.columns])
    entry = F.struct("t", vector.alias("x"), *carry)
    lists = rows.groupBy("subject_id").agg(F.sort_array(F.collect_list(entry)).alias("_s"))
    return lists.select(
        "subject_id",
        F.col("_s.t").alias("ts"),
        F.col("_s.x").alias("xs"),
        *[F.col(f"_s.{c}").alias(c) for c in carry],
    )


def log_rows(prefix: DataFrame, spec: PanelSpec) -> DataFrame:
    """Features replaced by their log1p, not yet scaled."""
    return prefix.withColumns({c: F.log1p(F.col(c).cast("double")) for c in spec.features.columns})


def landmark(prefix: DataFrame, spec: PanelSpec) -> DataFrame:
    """Last prefix row of each subject at or before the cutoff."""
    kept = [c for c in prefix.columns if c != "subject_id"]
    early = prefix.where(F.col("t") <= spec.t_cutoff)
    return early.groupBy("subject_id").agg(F.max_by(F.struct(*kept), "t").alias("_s")).select("subject_id", "_s.*")


def restrict(df: DataFrame, subjects: DataFrame) -> DataFrame:
    return df.join(by_key(subjects.select("subject_id")), "subject_id", "left_semi")
