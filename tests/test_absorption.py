"""Wide factors: residuals against least squares over all indicators; no level reaches the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftpanel.operators import absorption, partial
from driftpanel.operators.absorption import absorb
from driftpanel.operators.partial import residualise


def made(spark, n, levels, seed=1):
    rng = np.random.default_rng(seed)
    table = pd.DataFrame({f"g{i}": np.char.add("L", rng.integers(0, k, n).astype(str)) for i, k in enumerate(levels)})
    table.loc[rng.random(n) < 0.3, "g0"] = "L0"
    table["dose"] = rng.normal(size=n) + table["g0"].str[1:].astype(int) % 5
    table["y"] = table["dose"] + table["g1"].str[1:].astype(int) % 7 + rng.normal(size=n)
    table["x"] = rng.normal(size=n) * 100 + 1000
    table.insert(0, "id", np.arange(n))
    return table, spark.createDataFrame(table)


def least_squares(table, factors, numeric, targets):
    columns = [np.ones(len(table))] + [table[c].to_numpy(float) for c in numeric]
    columns += [(table[f] == v).to_numpy(float) for f in factors for v in sorted(table[f].unique())]
    design = np.column_stack(columns)
    y = table[targets].to_numpy(float)
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


@pytest.mark.parametrize("levels", [(30, 20), (25, 15, 10), (3, 40, 2)])
def test_absorbed_factors_equal_least_squares(spark, monkeypatch, levels):
    monkeypatch.setattr(partial, "DENSE_LEVELS", 4)
    table, df = made(spark, 400, levels)
    factors = [f"g{i}" for i in range(len(levels))]
    got = residualise(df, ["x", "y"], ["dose"], factors).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    assert np.abs(got - least_squares(table, factors, ["dose"], ["x", "y"])).max() < 1e-6


def test_a_covariate_that_the_levels_explain_drops_out(spark, monkeypatch):
    monkeypatch.setattr(partial, "DENSE_LEVELS", 0)
    table, _ = made(spark, 300, (12, 9))
    table["dose"] = table["g0"].str[1:].astype(float) * 3 + table["g1"].str[1:].astype(float)
    got = residualise(spark.createDataFrame(table), ["y"], ["dose"], ["g0", "g1"]).toPandas().sort_values("id")["y"].to_numpy()
    assert np.abs(got - least_squares(table, ["g0", "g1"], [], ["y"])[:, 0]).max() < 1e-6


def test_two_factors_of_100_000_levels(spark, monkeypatch):
    n, levels = 600_000, 100_000
    level = lambda seed: F.concat(F.lit("L"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(levels)).cast("string"))
    df = spark.range(0, n, 1, 8).select("id", level(1).alias("g0"), level(2).alias("g1"), F.sin("id").alias("y"), F.pmod("id", F.lit(97)).cast("double").alias("dose"))
    df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/wide")
    df = spark.read.parquet(path)
    from pyspark.sql.classic.dataframe import DataFrame

    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(len(rows := collect(self))) or rows)
    got = absorb(df, ["y", "dose"], ["g0", "g1"]).select("id", "y", "dose").toArrow().to_pandas().sort_values("id")
    assert max(collected, default=0) <= 1
    table = df.toArrow().to_pandas().sort_values("id")
    codes = [pd.factorize(table[f])[0] for f in ("g0", "g1")]
    means = lambda v, c: (np.bincount(c, v) / np.bincount(c))[c]
    for column in ("y", "dose"):
        rest = got[column].to_numpy()
        # residuals are orthogonal to all indicators, and what was taken away lies in their span: alternating means leave nothing of it
        assert max(np.abs(np.bincount(c, rest)).max() for c in codes) < 1e-5
        taken = table[column].to_numpy() - rest
        for _ in range(200):
            for c in codes:
                taken = taken - means(taken, c)
        assert np.abs(taken).max() < 1e-5


def test_too_few_rounds_are_reported(spark):
    _, df = made(spark, 300, (40, 30))
    with pytest.raises(absorption.NotConverged):
        absorb(df, ["y"], ["g0", "g1"], most_rounds=2)
