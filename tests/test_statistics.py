from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_data import SPEC
from driftpanel.functions import ranks
from driftpanel.functions import sampling
from driftpanel.functions.pvalues import correlation_p_value
from driftpanel.operators import ordering, resample as rs, stats
from driftpanel.operators.partial import partial_spearman, residualise
from driftpanel.operators.resample import resample


def rho(x, y):
    return float(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])


def skewed_values(n=3000, seed=1):
    """A third of the rows share one value; the rest spread over many magnitudes, with ties."""
    rng = np.random.default_rng(seed)
    x = np.round(np.exp(rng.normal(0, 4, n)), 3)
    x[: n // 3] = 7.5
    return x


@pytest.fixture(params=[200_000, 10])
def path(request, monkeypatch):
    """Run with the fewest buckets and with very many."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", request.param)


def test_buckets_grow_with_rows():
    assert [ranks.buckets_for(n) for n in (0, 1, 200_000, 10**7, 10**10)] == [8, 8, 8, 64, 65536]


def test_percentiles_are_exact_on_skewed_values(spark, path):
    a, b = skewed_values(seed=1), np.random.default_rng(2).integers(0, 3, 3000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "g": np.arange(3000) % 2})).repartition(5)
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]
    got = {(r.feature, r.p): r.value for r in ranks.exact_percentiles(df, ["a", "b"], p).collect()}
    for name, values in (("a", a), ("b", b)):
        assert [got[(name, q)] for q in p] == pytest.approx(np.percentile(values, np.array(p) * 100))
    grouped = {(r.g, r.p): r.value for r in ranks.exact_percentiles(df, ["a"], p, ["g"], buckets=16).collect()}
    for g in (0, 1):
        assert [grouped[(g, q)] for q in p] == pytest.approx(np.percentile(a[g::2], np.array(p) * 100))


@pytest.mark.parametrize("buckets", [2, 16, 128])
def test_ranks_do_not_depend_on_buckets(spark, buckets):
    x = skewed_values()
    table = spark.createDataFrame(pd.DataFrame({"x": x})).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = {r.x: r.r for r in ranks.mid_ranks(ranks.running_totals(table, "x", ["n"], buckets=buckets).drop("cum_n"), "x", name="r").collect()}
    expected = pd.Series(x).rank()
    assert all(got[v] == r for v, r in zip(x, expected))


def test_row_ranks_survive_a_hot_value(spark, path):
    x = skewed_values()
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    got = ranks.average_ranks(df, "x", "r").toPandas().sort_values("i")
    assert len(got) == len(x) and np.allclose(got["r"], pd.Series(x).rank())


def test_hot_rows_are_spread_over_the_shuffle(spark):
    x = skewed_values()
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    plan = ranks.average_ranks(df, "x", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert any("_slot" in line for line in joins)


def test_spearman_matches_numpy_with_ties_and_hot_values(spark, path):
    x, y = skewed_values(seed=3), skewed_values(seed=4)[::-1].copy()
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    row = stats.spearman(df, "x", "y").first()
    assert row.n == len(x) and row.rho == pytest.approx(rho(x, y), abs=1e-10)
    assert stats.spearman(df.withColumn("y", F.lit(1.0)), "x", "y").first().rho is None


def binary(n=400, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return y, np.round(1 / (1 + np.exp(-(rng.normal(0, 1, n) + 0.7 * y))), 2)


def brute_auc(y, s):
    pairs = s[y == 1][:, None] - s[y == 0][None]
    return ((pairs > 0) + 0.5 * (pairs == 0)).mean()


def brute_ap(y, s):
    out = 0.0
    for v in np.unique(s):
        called = s >= v
        out += (y[s == v].sum() / y.sum()) * y[called].mean()
    return out


def test_roc_and_precision_match_brute_force(spark, path):
    y, s = binary()
    df = spark.createDataFrame(pd.DataFrame({"risk": s, "target": y}))
    assert stats.roc_auc(df, "risk", "target").first().roc_auc == pytest.approx(brute_auc(y, s))
    assert stats.average_precision(df, "risk", "target").first().average_precision == pytest.approx(brute_ap(y, s))
    curve = stats.roc_points(df, "risk", "target").toPandas().sort_values(["fpr", "tpr"])
    assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(brute_auc(y, s))
    counts = stats.confusion(df, "risk", "target").first()
    assert counts.true_positive == ((s >= 0.5) & (y == 1)).sum() and counts.sensitivity == pytest.approx((s >= 0.5)[y == 1].mean())
    one_class = df.where("target = 1")
    assert stats.roc_auc(one_class, "risk", "target").first().roc_auc is None


def profile_of(spark, x, y, levels):
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    return stats.class_profile(df, "y", "x", levels).cache()


def expand(weights, values, classes):
    """Counts (values, classes) back to rows."""
    v, c = np.nonzero(weights)
    times = weights[v, c]
    return np.repeat(classes[c], times), np.repeat(values[v], times)


def drawn_weights(kind, y, s, seed, iterations):
    """Distinct values and (iteration, value, class) counts by the whole tree at once."""
    values, at = np.unique(s, return_inverse=True)
    counts = np.zeros((len(values), 2), np.int64)
    np.add.at(counts, (at, y), 1)
    keys, levels = sampling.iteration_keys(seed, np.arange(iterations)), (len(values) - 1).bit_length()
    if kind == "bootstrap":
        cells = sampling.spread_draws(np.full(iterations, len(y)), counts.ravel(), levels + 1, keys, 0)
        return values, cells.reshape(iterations, -1, 2)
    return values, sampling.spread_labels(np.tile(counts.sum(0), (iterations, 1)), counts.sum(1), levels, keys, 0)


@pytest.mark.parametrize("kind", ["bootstrap", "permutation"])
def test_statistics_are_those_of_the_drawn_rows_for_any_ranges(spark, monkeypatch, kind):
    y, s = binary(500, seed=8)
    profile = profile_of(spark, y, s, [0, 1])
    values, weights = drawn_weights(kind, y, s, 3, 6)
    found = []
    for bucket_values in (1 << 16, 32, 4):
        monkeypatch.setattr(rs, "BUCKET_VALUES", bucket_values)
        got = resample(profile, 2, kind, 3, 6, precision=True).withColumn("auc", stats.auc_from_moments())
        found.append(got.toPandas().set_index("iter").sort_index())
        for i in range(6):
            drawn_y, drawn_s = expand(weights[i], values, np.array([0, 1]))
            assert len(drawn_y) == 500
            if kind == "permutation":
                assert drawn_y.sum() == y.sum() and sorted(drawn_s) == sorted(s)
            assert found[-1].loc[i, "auc"] == pytest.approx(brute_auc(drawn_y, drawn_s))
            assert found[-1].loc[i, "ap"] == pytest.approx(brute_ap(drawn_y, drawn_s))
    for other in found[1:]:
        assert (other[["w0", "w1", "r0", "r1", "q"]] == found[0][["w0", "w1", "r0", "r1", "q"]]).all().all()


@pytest.mark.parametrize("kind", ["bootstrap", "permutation"])
def test_ten_to_the_tenth_subjects_by_counts(spark, monkeypatch, kind):
    monkeypatch.setattr(rs, "BUCKET_VALUES", 4)
    rows = [(float(v), 10**9 - 10**8 * (v % 3), 10**8 * (v % 3)) for v in range(10)]
    profile = spark.createDataFrame(rows, "value double, n0 long, n1 long")
    got = resample(profile, 2, kind, 5, 16).withColumn("auc", stats.auc_from_moments()).toPandas()
    assert (got["w0"] + got["w1"] == 10**10).all() and got["w1"].nunique() == (1 if kind == "permutation" else 16)
    n0, n1 = (np.array([r[k] for r in rows], float) for k in (1, 2))
    below = np.cumsum(n0) - n0
    expected = 0.5 if kind == "permutation" else (n1 * (below + n0 / 2)).sum() / (n0.sum() * n1.sum())
    assert 0 < got["auc"].std() < 1e-4 and got["auc"].sub(expected).abs().max() < 1e-4


def cohort(spark, index, n_per_arm=15):
    rows = [(f"F{a}{i:03d}", arm, float(index(a))) for a, arm in enumerate(SPEC.arms) for i in range(n_per_arm)]
    df = spark.createDataFrame(rows, "subject_id string, arm string, mean_state_index double")
    return df.select("subject_id", "mean_state_index"), df.select("subject_id", "arm")


def test_order_test_finds_a_planted_trend(spark):
    rng = np.random.default_rng(1)
    index, outcomes = cohort(spark, lambda a: a + rng.normal(0, 0.15))
    row = ordering.primary_test(index, outcomes, SPEC, 7, 400, 400).first()
    assert row.rho > 0.8 and row.one_sided_p < 0.01 and row.ci_low > 0.5
    assert abs(row.null_mean) < 0.05 and row.null_sd == pytest.approx(1 / np.sqrt(59), rel=0.2)


def test_order_test_finds_nothing_in_noise(spark):
    rng = np.random.default_rng(2)
    index, outcomes = cohort(spark, lambda a: rng.normal())
    row = ordering.primary_test(index, outcomes, SPEC, 9, 200, 400).first()
    assert abs(row.rho) < 0.25 and row.one_sided_p > 0.05


def test_leaving_out_an_arm_leaves_the_other_subjects(spark, path):
    index, outcomes = cohort(spark, lambda a: a, 10)
    rows = ordering.leave_one_arm_out(index, outcomes, SPEC).collect()
    assert {r.held_out: r.n for r in rows} == {a: 30 for a in SPEC.arms}
    assert all(r.rho == pytest.approx(1.0) for r in rows)


def test_p_values_against_known_ones():
    # two-sided Student t: t = 2.228139 with 10 degrees of freedom is the 5 % point
    t, df = 2.2281388519649385, 10
    assert correlation_p_value(t / np.sqrt(df + t * t), df + 2) == pytest.approx(0.05, abs=1e-9)
    assert correlation_p_value(0.0, 30) == pytest.approx(1.0)
    assert correlation_p_value(1.0, 30) == 0.0 and correlation_p_value(None, 3) is None


def adjusted(x, y, design):
    ranked = [pd.Series(v).rank().to_numpy() for v in (x, y)]
    left = [v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in ranked]
    return rho(np.round(left[0], 9), np.round(left[1], 9))


@pytest.mark.parametrize("levels", [4, 90])
def test_partial_correlation_matches_least_squares(spark, levels):
    rng = np.random.default_rng(levels)
    n = 600
    group, batch, dose = rng.integers(0, levels, n), rng.integers(0, 3, n), rng.normal(size=n)
    x = dose + group % 5 + rng.normal(size=n)
    y = np.round(0.5 * dose + batch + 0.3 * x + rng.normal(size=n), 1)
    frame = pd.DataFrame({"x": x, "y": y, "dose": dose, "twice": 2 * dose, "same": 0.05, "g": [f"g{v:03d}" for v in group], "b": batch})
    dummies = [pd.get_dummies(frame[c], drop_first=True).to_numpy(float) for c in ("g", "b")]
    design = np.column_stack([np.ones(n), dose, 2 * dose, np.full(n, 0.05), *dummies])
    df = spark.createDataFrame(frame)
    row = partial_spearman(df, "x", "y", ["dose", "twice", "same"], ["g", "b"]).first()
    assert row.n == n and row.rho == pytest.approx(adjusted(x, y, design), abs=1e-6)


@pytest.mark.parametrize("levels", [2, 64, 65, 1000])
def test_partial_correlation_with_nulls(spark, levels):
    """A NULL level has no indicator, and rows with a NULL number are left out, at every number of levels."""
    rng = np.random.default_rng(levels)
    n = 4000
    group, batch, dose = rng.integers(0, levels, n), rng.integers(0, 40, n), rng.normal(size=n)
    x = dose + group % 5 + rng.normal(size=n)
    y = 0.5 * dose + batch + 0.3 * x + rng.normal(size=n)
    frame = pd.DataFrame({"x": x, "y": y, "dose": dose, "g": [f"g{v:04d}" for v in group], "b": [f"b{v:02d}" for v in batch]})
    frame.loc[::10, "g"], frame.loc[::7, "b"] = None, None
    rows = [tuple(None if i % 13 == 0 and c == "dose" else v for c, v in zip(frame.columns, r)) for i, r in enumerate(frame.itertuples(index=False))]
    used = frame[np.arange(n) % 13 != 0]
    dummies = [pd.get_dummies(used[c], drop_first=True).to_numpy(float) for c in ("g", "b")]
    design = np.column_stack([np.ones(len(used)), used["dose"], *dummies])
    df = spark.createDataFrame(rows, "x double, y double, dose double, g string, b string")
    row = partial_spearman(df, "x", "y", ["dose"], ["g", "b"]).first()
    assert row.n == len(used) and row.rho == pytest.approx(adjusted(used["x"], used["y"], design), abs=1e-6)


def test_partial_correlation_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0, None)], "x double, y double, dose double, g string")
    row = partial_spearman(df, "x", "y", ["dose"], ["g"]).first()
    assert (row.n or 0) == 0 and row.rho is None


def test_partial_correlation_without_covariates_is_spearman(spark):
    x, y = skewed_values(300, 6), skewed_values(300, 7)[::-1].copy()
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert partial_spearman(df, "x", "y").first().rho == pytest.approx(rho(x, y), abs=1e-9)
    assert residualise(df, ["x"], [], []).agg(F.avg("x")).first()[0] == pytest.approx(0.0, abs=1e-6)
