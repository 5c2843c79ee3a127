"""Rank statistics and classification metrics, exact and free of global single-task sorts.

Most inputs pair a numeric value with a small declared set of ordered classes (arms, or the
0/1 target). They are reduced to one row per distinct value with a count per class; ranks,
ROC, and precision all follow from running totals over those rows, without joining back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.columns import alarm
from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.pvalues import p_value
from driftpanel.functions.ranks import attach, mid_ranks, running_totals


def class_names(n: int) -> list[str]:
    return [f"n{i}" for i in range(n)]


def class_profile(df: DataFrame, value: str, cls: Column | str, levels: Sequence, group: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct value): count ``n{i}`` of each class level, and ``n``.

    Rows without a value or a known class are left out.
    """
    cls = F.col(cls) if isinstance(cls, str) else cls
    known = df.where(F.col(value).isNotNull()).withColumn("_class", cls).where(F.col("_class").isin(list(levels)))
    counts = [F.count_if(F.col("_class") == level).alias(f"n{i}") for i, level in enumerate(levels)]
    return known.groupBy(*group, F.col(value).alias("value")).agg(*counts, F.count(F.lit(1)).alias("n"))


def rank_moments(profile: DataFrame, n_classes: int, group: Sequence[str] = ()) -> DataFrame:
    """Per class its size ``w{i}`` and rank sum ``r{i}``, and ``q``, the sum of squared ranks."""
    ranked = mid_ranks(profile, "value", group=group)
    per_class = []
    for i in range(n_classes):
        per_class += [F.sum(f"n{i}").alias(f"w{i}"), F.sum(F.col(f"n{i}") * F.col("rank")).alias(f"r{i}")]
    return ranked.groupBy(*group).agg(*per_class, F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("q"))


def _total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def rho_from_moments(n_classes: int) -> Column:
    """Spearman's rho between class order and value rank; NULL when either side is constant."""
    w = [F.col(f"w{i}").cast("double") for i in range(n_classes)]
    r = [F.col(f"r{i}") for i in range(n_classes)]
    n = _total(w)
    mean = (n + 1) / 2
    below = F.lit(0.0)
    cov, var_x = F.lit(0.0), F.lit(0.0)
    for wi, ri in zip(w, r):
        x = below + (wi + 1) / 2 - mean
        cov = cov + F.when(wi > 0, x * (ri - wi * mean)).otherwise(0.0)
        var_x = var_x + wi * x * x
        below = below + wi
    var_y = F.col("q") - n * mean * mean
    return F.when((var_x > 1e-9) & (var_y > 1e-9), cov / F.sqrt(var_x * var_y))


def auc_from_moments() -> Column:
    """ROC-AUC from the rank sum of class 1; NULL without both classes."""
    n0, n1 = F.col("w0").cast("double"), F.col("w1").cast("double")
    return F.when((n0 > 0) & (n1 > 0), (F.col("r1") - n1 * (n1 + 1) / 2) / (n0 * n1))


def size_from_moments(n_classes: int) -> Column:
    return _total([F.col(f"w{i}") for i in range(n_classes)]).cast("long")


def spearman_ordinal(df: DataFrame, value: str, cls: Column | str, levels: Sequence) -> DataFrame:
    """One row ``n, rho`` of a numeric value against ordered classes."""
    moments = rank_moments(class_profile(df, value, cls, levels), len(levels))
    return moments.select(size_from_moments(len(levels)).alias("n"), rho_from_moments(len(levels)).alias("rho"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, rho`` of two numeric columns; pairs with a NULL are left out.

    Equal pairs are counted first, and common values are attached by the skew-safe lookup. Pairs
    and ranks are read several times, so each is written once.
    """
    pairs = cut_lineage(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = pairs
    for side in ("x", "y"):
        margin = pairs.groupBy(side).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_cells"))
        ranks = cut_lineage(mid_ranks(margin, side, name=f"r{side}"))
        ranked = attach(ranked, ranks, side, "_cells", [f"r{side}"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    sums = ranked.agg(
        F.sum("n").alias("n"),
        F.sum(n * rx * ry).alias("xy"),
        F.sum(n * rx * rx).alias("xx"),
        F.sum(n * ry * ry).alias("yy"),
    )
    shift = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4.0
    var_x, var_y = F.col("xx") - shift, F.col("yy") - shift
    rho = F.when((var_x > 1e-9) & (var_y > 1e-9), (F.col("xy") - shift) / F.sqrt(var_x * var_y))
    return sums.select("n", rho.alias("rho"))


def with_p_value(result: DataFrame) -> DataFrame:
    return result.withColumn("p", p_value("rho", "n"))


# --- binary targets --------------------------------------------------------------------


def score_profile(df: DataFrame, score: str, target: str, group: Sequence[str] = ()) -> DataFrame:
    return class_profile(df, score, target, [0, 1], group)


def roc_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    moments = rank_moments(score_profile(df, score, target), 2)
    return moments.select(
        F.col("w1").alias("n_positive"), F.col("w0").alias("n_negative"), auc_from_moments().alias("roc_auc")
    )


def threshold_counts(df: DataFrame, score: str, target: str, group: Sequence[str] = ()) -> DataFrame:
    """True and false positives at or above each distinct score."""
    cumulative = running_totals(score_profile(df, score, target, group), "value", ["n0", "n1"], group, descending=True)
    return cumulative.select(
        *group, F.col("value").alias("threshold"), "n0", "n1", F.col("cum_n1").alias("tp"), F.col("cum_n0").alias("fp")
    )


def average_precision(df: DataFrame, score: str, target: str, group: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores."""
    step = F.col("n1") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return threshold_counts(df, score, target, group).groupBy(*group).agg(
        F.try_divide(F.sum(step), F.sum("n1")).alias("average_precision")
    )


def roc_points(df: DataFrame, score: str, target: str) -> DataFrame:
    """Every ROC point: threshold, fpr, tpr, and the origin with an infinite threshold."""
    counts = threshold_counts(df, score, target)
    totals = score_profile(df, score, target).agg(F.sum("n1").alias("_pos"), F.sum("n0").alias("_neg"))
    points = counts.crossJoin(F.broadcast(totals)).select(
        "threshold",
        F.try_divide(F.col("fp"), F.col("_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("_pos")).alias("tpr"),
    )
    origin = totals.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def confusion(df: DataFrame, score: str, target: str, threshold: float = 0.5) -> DataFrame:
    called, hit = alarm(score, threshold), F.col(target) == 1
    counts = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).agg(
        F.count_if(called & hit).alias("true_positive"),
        F.count_if(~called & ~hit).alias("true_negative"),
        F.count_if(called & ~hit).alias("false_positive"),
        F.count_if(~called & hit).alias("false_negative"),
    )
    positives = F.greatest(F.lit(1), F.col("true_positive") + F.col("false_negative"))
    negatives = F.greatest(F.lit(1), F.col("true_negative") + F.col("false_positive"))
    return counts.withColumns(
        {"sensitivity": F.col("true_positive") / positives, "specificity": F.col("true_negative") / negatives}
    )


def brier(df: DataFrame, score: str, target: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(target)) * (F.col(score) - F.col(target))).alias("brier_score"))


def calibration(df: DataFrame, score: str, target: str, threshold: float = 0.5) -> DataFrame:
    from driftpanel.functions.ranks import exact_percentiles

    summary = df.agg(
        F.avg(F.col(target).cast("double")).alias("observed_positive_rate"),
        F.avg(score).alias("mean_risk"),
        F.max(score).alias("max_risk"),
        F.count_if(alarm(score, threshold)).alias("n_above_threshold"),
    )
    median = exact_percentiles(df, [score], [0.5]).agg(F.max("value").alias("median_risk"))
    return summary.crossJoin(F.broadcast(median))


def percentile_interval(draws: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Central interval of a resample distribution; a draw table has one row per iteration."""
    ends = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return draws.agg(F.count(value).alias("n_draws"), ends.alias("_e")).select(
        "n_draws", F.get("_e", F.lit(0)).alias("ci_low"), F.get("_e", F.lit(1)).alias("ci_high")
    )
