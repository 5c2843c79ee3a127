"""All registered queries; importing the modules fills the registry."""

from driftpanel.plans import order_queries, state_queries, statistic_queries, table_queries  # noqa: F401
from driftpanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
