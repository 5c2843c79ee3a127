"""Tables that grow with the study are joined by shuffles: none is collected at the driver for a broadcast, however small it looks."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from driftpanel.functions.ranks import attach, rank_by_key
from driftpanel.operators import normalize as norm
from driftpanel.operators.behavior import merge_behavior
from driftpanel.operators.ordering import with_arm
from driftpanel.operators.quality import orphans
from driftpanel.operators.sequences import restrict
from driftpanel.operators.split import split_subjects
from driftpanel.operators.states import forecast
from driftpanel.plans.context import FIXED_MODEL
from driftpanel.sources.adapters import ORDER_SPEC, order_study


def sides(df) -> list[str]:
    """The broadcast joins of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin[^\n]*|BroadcastNestedLoopJoin[^\n]*", plan)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    day = lambda year: datetime.datetime(year, 5, 1)
    orders = [(c * 10 + i, c, day(y)) for c in range(6) for i, y in enumerate((1995, 1998, 2001))]
    lines = [(k, n, 10.0 * n, 900.0 + k, 0.05, "R" if n == 1 else "N") for k, _, _ in orders for n in (1, 2, 3)]
    customers = [(c, ORDER_SPEC.arms[c % 5]) for c in range(6)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"),
        "customer": (customers, "c_custkey long, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return order_study(spark, folder)


def test_order_study(raw):
    assert raw.sessions.count() == 18 and raw.event_log.count() == 18
    for table in (raw.sessions, raw.event_log, raw.outcomes):
        assert not sides(table)


def test_normalised_tables(raw):
    outcomes = norm.normalize_outcomes(raw.sessions, raw.outcomes, raw.event_log, ORDER_SPEC)
    assert outcomes.count() == 6
    assert not sides(outcomes)
    # bucket tables of the median and the median itself are broadcast by name
    silent = sides(norm.materialize_silent_sessions(raw.sessions, raw.event_log))
    assert silent and not any("subject_id" in s for s in silent), silent


def test_joins_by_subject(spark):
    ids = spark.range(8).select(F.col("id").cast("string").alias("subject_id"))
    outcomes = ids.select("subject_id", F.lit("a0").alias("arm"), F.lit(1).alias("target"), F.lit(0).alias("batch"), F.lit(1.0).alias("dose"))
    decoded = ids.select("subject_id", F.array(F.lit(4)).alias("ts"), F.array(F.lit("a0")).alias("arm"), F.array(F.array(*[F.lit(1 / 3)] * 3)).alias("posterior"))
    assert not sides(restrict(outcomes, ids))
    assert not sides(with_arm(ids, outcomes))
    forecasts = forecast(decoded, outcomes, FIXED_MODEL, [2, 0, 1], ORDER_SPEC)
    assert not sides(forecasts)
    behavior = ids.select("subject_id", F.lit(6).alias("t"), F.lit(True).alias("tracking_qc_pass"), F.lit(0.5).alias("abnormality"))
    assert not sides(merge_behavior(forecasts, behavior, ORDER_SPEC))
    assert not sides(orphans(ids, outcomes, ids))
    assert merge_behavior(forecasts, behavior, ORDER_SPEC).count() == 8


def test_ranks(spark):
    rows = spark.range(40).select("id", F.lit("g").alias("g"), F.md5(F.col("id").cast("string")).alias("key"))
    ranked = rank_by_key(rows, ["g"], "key", "id", "place")
    assert not sides(ranked)
    assert sorted(r.place for r in ranked.collect()) == list(range(1, 41))
    lookup = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    # only the keys of more than 1/256 of the rows are broadcast, and the row of their total
    attached = sides(attach(rows, lookup, "key", "n", ["top"]))
    assert sum("BroadcastHashJoin" in s for s in attached) == 1, attached


def test_split(raw):
    outcomes = norm.normalize_outcomes(raw.sessions, raw.outcomes, raw.event_log, ORDER_SPEC)
    joined = sides(split_subjects(outcomes))
    # quotas per stratum and gaps per arm are broadcast by name
    assert joined and all(re.match(r"BroadcastHashJoin \[(arm|stratum)#\d+\], ", s) for s in joined), joined
