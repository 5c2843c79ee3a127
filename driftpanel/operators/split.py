"""Leakage-free subject split and stratified folds, ordered by seeded hash keys.

Quota tables hold one row per arm or per arm and target class of the study; they are broadcast,
so that subjects are never shuffled by an arm that may hold most of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.columns import stratum
from driftpanel.functions.hashing import order_key
from driftpanel.functions.ranks import rank_by_key


def _share(fraction: float, n: str) -> Column:
    """fraction * n rounded half to even."""
    return F.bround(F.lit(float(fraction)) * F.col(n)).cast("long")


def stratified_pick(outcomes: DataFrame, test_fraction: float, seed: int) -> DataFrame:
    """First pass: the share of each arm-and-target stratum that goes to test."""
    base = outcomes.select("subject_id", "arm", "target").withColumns(
        {"stratum": stratum(), "_key": order_key(seed, "split")}
    )
    sizes = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    quota = F.when(
        F.col("_n") >= 3, F.greatest(F.lit(1), F.least(F.col("_n") - 1, _share(test_fraction, "_n")))
    ).otherwise(F.lit(0))
    ranked = rank_by_key(base, ["stratum"], "_key", "subject_id", "_place")
    return (
        ranked.join(F.broadcast(sizes.select("stratum", quota.alias("_quota"))), "stratum")
        .withColumn("is_test", F.col("_place") <= F.col("_quota"))
        .select("subject_id", "arm", "target", "stratum", "is_test")
    )


def rebalance_arms(picked: DataFrame, test_fraction: float, seed: int) -> DataFrame:
    """Second pass: move hash-chosen subjects until each arm holds its rounded test share."""
    arms = picked.groupBy("arm").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_test").alias("_now"))
    gap = arms.select("arm", (_share(test_fraction, "_n") - F.col("_now")).alias("_gap"))
    keyed = picked.withColumn("_key", order_key(seed, "rebalance"))
    ranked = rank_by_key(keyed, ["arm", "is_test"], "_key", "subject_id", "_place")
    moves = (F.col("_place") <= F.abs("_gap")) & (
        ((F.col("_gap") > 0) & ~F.col("is_test")) | ((F.col("_gap") < 0) & F.col("is_test"))
    )
    return ranked.join(F.broadcast(gap), "arm").withColumn("is_test", F.col("is_test") != moves).drop("_key", "_place", "_gap")


def split_subjects(outcomes: DataFrame, test_fraction: float = 0.30, seed: int = 42) -> DataFrame:
    """Assignment table ``subject_id, arm, target, split``."""
    if not 0.1 <= test_fraction <= 0.5:
        raise ValueError("test_fraction must be between 0.1 and 0.5")
    final = rebalance_arms(stratified_pick(outcomes, test_fraction, seed), test_fraction, seed)
    split = F.when(F.col("is_test"), "test").otherwise("train").alias("split")
    return final.select("subject_id", "arm", "target", split)


def assign_folds(assignments: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Fold number of each train subject, dealt out in hash order within its arm."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    train = assignments.where(F.col("split") == "train").select("subject_id", "arm")
    keyed = train.withColumn("_key", order_key(seed, "fold"))
    ranked = rank_by_key(keyed, ["arm"], "_key", "subject_id", "_place")
    return ranked.select("subject_id", "arm", ((F.col("_place") - 1) % folds).cast("int").alias("fold"))
