"""Registry of named queries: a function over the study context, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from driftpanel.plans.context import Context, context
from driftpanel.plans.oracle import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: Sequence[str] = (), sql: str | None = None, kind: str = "events", extra=None):
    """Register ``build(context)`` under ``name``; ``sql`` is the final SELECT over fragments ``uses``."""

    def register(build: Callable[[Context], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(context(spark, sf_dir, kind))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(uses, sql, extra)
        return build

    return register
