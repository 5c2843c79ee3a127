"""Keyed draws against exact probabilities, and splits that do not depend on how the tree is divided."""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pytest

from driftpanel.functions import sampling as s


def inverse(probabilities, u):
    """Least k whose cumulated probability exceeds u, in fractions."""
    total = Fraction(0)
    for k, p in enumerate(probabilities):
        total += p
        if total > Fraction(float(u)):
            return k
    raise AssertionError


@pytest.mark.parametrize("n, left, right", [(1, 1, 1), (7, 1, 3), (40, 5, 1), (30, 10**6, 1), (60, 1, 10**9), (200, 3, 4)])
def test_binomial_inverts_the_exact_distribution(n, left, right):
    u = s.uniform(s.iteration_keys(4, np.arange(300)), s.node_keys(2, np.arange(300)))
    share = Fraction(left, left + right)
    p = [comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
    got = s.binomial(np.full(300, n), np.full(300, left), np.full(300, right), u)
    assert got.tolist() == [inverse(p, x) for x in u]


@pytest.mark.parametrize("good, bad, n", [(1, 1, 1), (3, 9, 5), (30, 2, 31), (2, 30, 31), (500, 700, 400), (1, 10**6, 10**5)])
def test_hypergeometric_inverts_the_exact_distribution(good, bad, n):
    u = s.uniform(s.iteration_keys(5, np.arange(200)), s.node_keys(0, np.arange(200)))
    whole = comb(good + bad, n)
    p = [Fraction(comb(good, k) * comb(bad, n - k), whole) if n - k >= 0 else Fraction(0) for k in range(min(good, n) + 1)]
    got = s.hypergeometric(np.full(200, good), np.full(200, bad), np.full(200, n), u)
    assert got.tolist() == [inverse(p, x) for x in u]


def test_ten_to_the_tenth_subjects():
    sizes = np.full(5, 2 * 10**9)
    keys = s.iteration_keys(1, np.arange(40))
    labels = s.spread_labels(np.tile([3 * 10**9, 10**9, 6 * 10**9], (40, 1)), sizes, 3, keys, 0)
    assert (labels.sum(2) == sizes).all() and (labels.sum(1) == [3 * 10**9, 10**9, 6 * 10**9]).all()
    expected = 2 * 10**9 * np.array([0.3, 0.1, 0.6])
    deviation = np.sqrt(expected * (1 - np.array([0.3, 0.1, 0.6])) * 0.8)
    z = (labels - expected) / deviation
    assert abs(z.mean()) < 0.15 and 0.85 < z.std() < 1.15
    draws = s.spread_draws(np.full(40, 10**10), sizes, 3, keys, 0)
    z = (draws - 2 * 10**9) / np.sqrt(10**10 * 0.2 * 0.8)
    assert (draws.sum(1) == 10**10).all() and abs(z.mean()) < 0.15 and 0.85 < z.std() < 1.15


def test_parts_of_the_tree_draw_the_same():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 50, 61)
    keys = s.iteration_keys(9, np.arange(7))
    whole = s.spread_draws(np.full(7, 1000), sizes, 6, keys, 0)
    totals = s.spread_draws(np.full(7, 1000), s.pyramid(sizes, 6)[3], 3, keys, 0, base=3)
    for part in range(8):
        inside = s.spread_draws(totals[:, part], sizes[part * 8 : part * 8 + 8], 3, keys, part * 8)
        assert (inside == whole[:, part * 8 : part * 8 + 8]).all()


def test_keys_do_not_meet():
    nodes = np.arange(1 << 12)
    keys = np.concatenate([s.node_keys(level, nodes, draw) for level in range(8) for draw in range(4)])
    assert len(np.unique(s.mix64(s.iteration_keys(1, np.arange(20))[:, None] + keys))) == 20 * len(keys)


def test_a_chunk_of_draws_has_bounded_memory():
    """What a task holds at a time follows from CHUNK_CELLS, whatever the values of its range and the subjects."""
    import tracemalloc

    from driftpanel.operators import resample

    for values, subjects in ((1 << 12, 1), (1 << 16, 1), (1 << 12, 10**6)):
        counts = np.zeros((values, 2), np.int64)
        counts[np.arange(values), np.arange(values) % 2] = subjects
        part = np.arange(max(1, resample.CHUNK_CELLS // counts.size))
        tracemalloc.start()
        drawn = resample._weights("bootstrap", counts, counts.sum(0).tolist(), [], 0, (values - 1).bit_length(), 5, part)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (drawn.sum((1, 2)) == counts.sum()).all()
        assert peak < 40 << 20, (values, subjects, peak)
