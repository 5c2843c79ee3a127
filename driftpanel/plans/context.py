"""Shared intermediate tables of one study, built lazily and materialised once per session."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpanel.functions.lineage import cut_lineage
from driftpanel.operators.baseline import Baseline
from driftpanel.operators import behavior as behave
from driftpanel.operators.hmm import HmmModel
from driftpanel.operators.normalize import normalize_behavior, normalize_outcomes, normalize_sessions
from driftpanel.operators.sequences import contiguous_prefix, fit_scaler, qc_sessions, restrict
from driftpanel.operators.split import assign_folds, split_subjects
from driftpanel.operators.states import decode, forecast, model_sequences, score_sessions, severity_order, state_index
from driftpanel.sources.adapters import EVENT_SPEC, ORDER_SPEC, RawStudy, event_study, order_study

# Fixed three-state and two-state parameter sets for checks of the inference operators.
# Raw states are deliberately not in severity order: middle, high, low.
FIXED_MODEL = HmmModel(
    start=np.array([0.3, 0.1, 0.6]),
    trans=np.array([[0.6, 0.25, 0.15], [0.2, 0.7, 0.1], [0.3, 0.1, 0.6]]),
    means=np.array([[0.3, 0.1, 0.4, 0.2], [1.1, 0.6, 1.2, 1.0], [-0.6, -0.4, -0.1, -0.7]]),
    covars=np.array([[0.9, 0.8, 0.7, 1.1], [1.3, 1.2, 0.9, 1.0], [0.8, 1.1, 0.6, 0.9]]),
)
FIXED_TWO_STATE = HmmModel(
    start=np.array([0.35, 0.65]),
    trans=np.array([[0.7, 0.3], [0.2, 0.8]]),
    means=np.array([[0.8, 0.4, 0.9, 0.7], [-0.4, -0.3, 0.0, -0.5]]),
    covars=np.array([[1.2, 1.1, 0.9, 1.0], [0.9, 1.0, 0.7, 1.1]]),
)

#: A fixed elastic-net model: intercept and one weight per scaled feature.
FIXED_BASELINE = Baseline(1.0, 0.5, np.array([-0.4, 0.7, 0.0, -0.3, 0.5]), 0, {})


class Context:
    """Study tables over one folder of source tables; every property is a DataFrame unless noted."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "events"):
        self.spark, self.sf_dir = spark, sf_dir
        self.spec = EVENT_SPEC if kind == "events" else ORDER_SPEC
        self.model = FIXED_MODEL
        self.order = severity_order(self.model, self.spec.features)
        self._build = event_study if kind == "events" else order_study

    @cached_property
    def raw(self) -> RawStudy:
        return self._build(self.spark, self.sf_dir, self.spec)

    @cached_property
    def lazy_sessions(self) -> DataFrame:
        """Normalised sessions as one unexecuted plan over the raw table."""
        return normalize_sessions(self.raw.sessions, self.spec)

    @cached_property
    def lazy_outcomes(self) -> DataFrame:
        """Normalised outcomes as one unexecuted plan over the raw tables."""
        return normalize_outcomes(self.lazy_sessions, self.raw.outcomes, self.raw.event_log, self.spec)

    @cached_property
    def sessions(self) -> DataFrame:
        return cut_lineage(self.lazy_sessions)

    @cached_property
    def outcomes(self) -> DataFrame:
        return cut_lineage(normalize_outcomes(self.sessions, self.raw.outcomes, self.raw.event_log, self.spec))

    @cached_property
    def behavior(self) -> DataFrame:
        return cut_lineage(normalize_behavior(self.sessions, self.raw.event_log))

    @cached_property
    def usable(self) -> DataFrame:
        return qc_sessions(self.sessions)

    @cached_property
    def prefix(self) -> DataFrame:
        return contiguous_prefix(self.usable, self.spec)

    @cached_property
    def assignments(self) -> DataFrame:
        return cut_lineage(split_subjects(self.outcomes))

    @cached_property
    def train(self) -> DataFrame:
        return self.assignments.where(F.col("split") == "train")

    @cached_property
    def test(self) -> DataFrame:
        return self.assignments.where(F.col("split") == "test")

    @cached_property
    def folds(self) -> DataFrame:
        return cut_lineage(assign_folds(self.assignments, 3))

    @cached_property
    def scaler(self) -> DataFrame:
        return cut_lineage(fit_scaler(restrict(self.prefix, self.train), self.spec))

    @cached_property
    def sequences(self) -> DataFrame:
        return cut_lineage(model_sequences(self.usable, self.scaler, self.spec))

    @cached_property
    def decoded(self) -> DataFrame:
        return cut_lineage(decode(self.sequences, self.model, self.order))

    @cached_property
    def scored(self) -> DataFrame:
        return cut_lineage(score_sessions(restrict(self.decoded, self.test)))

    @cached_property
    def forecasts(self) -> DataFrame:
        return cut_lineage(forecast(restrict(self.decoded, self.test), self.outcomes, self.model, self.order, self.spec))

    @cached_property
    def index(self) -> DataFrame:
        return cut_lineage(state_index(self.decoded))

    @cached_property
    def merged_behavior(self) -> DataFrame:
        return cut_lineage(behave.merge_behavior(self.forecasts, self.behavior, self.spec))


_CONTEXTS: dict[tuple[str, str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str, kind: str = "events") -> Context:
    """The context of this Spark application and folder, so that queries share materialised tables."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir, kind)
    return _CONTEXTS[key]


def forget_contexts() -> None:
    """Drop shared tables, so that the next query pays for everything it needs."""
    _CONTEXTS.clear()
