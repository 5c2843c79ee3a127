"""Latent-state panel analytics on Spark."""

import sys

from pyspark import cloudpickle

# Kernels that run in Python workers are shipped by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from driftpanel.operators.hmm import GaussianHMM  # noqa: E402
from driftpanel.plans.analysis import normalize_study, run_analysis, run_full_analysis  # noqa: E402
from driftpanel.spec import FeatureSpec, HmmOptions, PanelSpec  # noqa: E402

__all__ = ["FeatureSpec", "GaussianHMM", "HmmOptions", "PanelSpec", "normalize_study", "run_analysis", "run_full_analysis"]
