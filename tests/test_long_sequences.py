"""Chunked inference against the plain pass: paths, posteriors, likelihoods, expected counts; a sequence of 10^6 steps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpanel.operators import hmm
from driftpanel.operators.hmm import FitRequest, HmmModel, infer
from driftpanel.operators.long_sequences import cut_sequences, expected_counts, infer_steps
from driftpanel.spec import HmmOptions

MODEL = HmmModel(
    np.array([0.6, 0.4, 0.0]), np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.2, 0.8]]),
    np.array([[0.0, 1.0], [1.5, 0.0], [3.0, -1.0]]), np.array([[0.5, 0.8], [0.7, 0.4], [0.9, 0.6]]),
)


def sequences(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", rng.normal(1.0, 1.3, (n, 2)).tolist()) for i, n in enumerate(lengths)]
    whole = spark.createDataFrame(rows, "subject_id string, xs array<array<double>>")
    return whole, whole.select("subject_id", F.posexplode("xs").alias("t", "x"))


@pytest.mark.parametrize("chunk, fan", [(7, 2), (64, 3), (4096, 256)])
def test_equals_the_plain_pass(spark, chunk, fan):
    whole, steps = sequences(spark, [1, 2, 7, 8, 63, 64, 65, 900])
    got = infer_steps(steps, MODEL, chunk=chunk, fan=fan).toPandas().sort_values(["subject_id", "t"])
    for row in infer(whole, MODEL).collect():
        mine = got[got["subject_id"] == row.subject_id]
        assert mine["t"].tolist() == list(range(len(row.path))) and mine["state"].tolist() == row.path
        assert np.allclose(np.stack(mine["posterior"]), np.array(row.posterior), atol=1e-9)
        assert mine["gained"].sum() == pytest.approx(row.loglik, rel=1e-10)


@pytest.mark.parametrize("chunk, fan", [(5, 3), (4096, 256)])
def test_expected_counts_equal_the_plain_pass(spark, chunk, fan):
    model = HmmModel(MODEL.start * 0.97 + 0.01, MODEL.trans * 0.97 + 0.01, MODEL.means, MODEL.covars)
    whole, steps = sequences(spark, [1, 5, 6, 11, 240])
    run = hmm._Run(0, FitRequest(HmmOptions(3), (0.0, 0.0), (1.0, 1.0)), 0, model=model)
    stats = hmm._pass(hmm.prepare(whole), [run], hmm._expect)[0]
    want = np.split(stats, np.cumsum([1, 3, 9, 3, 6]))
    for mine, plain in zip(expected_counts(steps, model, chunk=chunk, fan=fan).values(), want, strict=True):
        assert np.allclose(mine.ravel(), plain, rtol=1e-8, atol=1e-8)


def test_a_sequence_of_a_million_steps(spark):
    n = 1_000_000
    noise = lambda seed: F.sqrt(-2 * F.log(F.rand(seed) + 1e-12)) * F.cos(2 * np.pi * F.rand(seed + 1))
    steps = spark.range(0, n, 1, 16).select(F.lit("one").alias("subject_id"), F.col("id").alias("t"), F.array(1.5 + noise(1), 0.3 * noise(5)).alias("x"))
    chunks = cut_sequences(steps)
    sizes = chunks.select(F.size("xs").alias("n")).toPandas()["n"]
    assert sizes.max() == 4096 and len(sizes) == 245
    got = infer_steps(steps, MODEL)
    row = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("places"), F.sum("gained").alias("ll"), F.max(F.abs(F.aggregate("posterior", F.lit(0.0), lambda a, v: a + v) - 1)).alias("off")).first()
    assert (row.n, row.places) == (n, n) and row.off < 1e-9
    table = steps.select("t", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")).toArrow().sort_by("t")
    x = np.column_stack([table.column(c).to_numpy() for c in ("a", "b")])
    weights = np.exp(hmm.log_density(x, MODEL.means, MODEL.covars))
    at, total = MODEL.start, 0.0
    for t in range(n):
        at = (at @ MODEL.trans if t else at) * weights[t]
        level = at.sum()
        total += np.log(level)
        at = at / level
    assert row.ll == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize("rows", [[("a", 1, [0.0, 1.0])], [("a", 0, [0.0, 1.0]), ("a", 2, [0.0, 1.0])], [("a", 0, [0.0, 1.0]), ("a", 0, [0.0, 1.0])], [(None, 0, [0.0, 1.0])]])
def test_gaps_and_repeats_are_refused(spark, rows):
    with pytest.raises(ValueError):
        infer_steps(spark.createDataFrame(rows, "subject_id string, t long, x array<double>"), MODEL, chunk=2)


def test_no_rows(spark):
    assert infer_steps(spark.createDataFrame([], "subject_id string, t long, x array<double>"), MODEL).collect() == []
