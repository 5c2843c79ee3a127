"""Keyed exact draws of binomial and hypergeometric counts, and splits of counts down a binary tree.

Every draw inverts its distribution at a uniform number that a 64-bit counter hash gives for (seed,
iteration, place in the tree). There is one generator for every size: nothing depends on how the
work is divided, and counts of 10^10 cost no more than the spread of the distribution.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed values of the 64-bit mixer.
MIX64 = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
#: Cells of one matrix of probabilities.
CELLS = 1 << 18
#: Draws look this many deviations around the mode, and this many counts more; what is beyond has less than 2^-53.
DEVIATIONS, MARGIN = 10.0, 12
#: Levels of the tree in a key, and draws that one node may need.
LEVEL_BITS, DRAW_BITS = 6, 4


def mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in MIX64:
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def stage_seed(seed: int, *stage) -> int:
    """A seed of its own for a named stage of a study."""
    digest = hashlib.md5("|".join(map(str, (seed, *stage))).encode()).hexdigest()
    return int(digest[:15], 16)


def iteration_keys(seed: int, iterations: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(np.uint64(seed % (1 << 64))) + np.asarray(iterations, dtype=np.uint64))


def node_keys(level: int, nodes: np.ndarray, draw: int = 0) -> np.ndarray:
    """Number of a draw at a node: the node covers the places ``node << level`` to ``(node + 1) << level``."""
    nodes = np.asarray(nodes, dtype=np.uint64)
    return (((nodes << np.uint64(LEVEL_BITS)) | np.uint64(level)) << np.uint64(DRAW_BITS)) | np.uint64(draw)


def uniform(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Uniform numbers inside (0, 1) of 53 bits for broadcast (iteration keys, node keys)."""
    with np.errstate(over="ignore"):
        mixed = mix64(keys + numbers)
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _invert(mode: np.ndarray, deviation: np.ndarray, u: np.ndarray, up, down) -> np.ndarray:
    """Least k whose cumulated probability exceeds u.

    ``up(rows, k)`` is P(k) / P(k - 1) and ``down(rows, k)`` is P(k) / P(k + 1); both are 0 beyond the support. Weights
    run from the mode outwards, so none grows, and their sum normalises them.
    """
    out = np.empty(len(mode), dtype=np.int64)
    reach = np.ceil(DEVIATIONS * deviation).astype(np.int64) + MARGIN
    order = np.argsort(reach, kind="stable")
    widths = reach[order]
    at = 0
    while at < len(order):
        # rows of similar reach together, in matrices of bounded size
        similar = int(np.searchsorted(widths, 2 * widths[at], side="right"))
        end = min(similar, at + max(1, CELLS // int(4 * widths[at] + 1)))
        rows = order[at:end]
        at = end
        steps = np.arange(1, int(widths[end - 1]) + 1)
        middle = mode[rows, None]
        above = np.cumprod(up(rows, middle + steps), axis=1)
        below = np.cumprod(down(rows, middle - steps), axis=1)[:, ::-1]
        total = np.concatenate([below, np.ones((len(rows), 1)), above], axis=1)
        np.cumsum(total, axis=1, out=total)
        out[rows] = mode[rows] - len(steps) + (total <= u[rows, None] * total[:, -1:]).sum(1)
    return out


def binomial(n: np.ndarray, left: np.ndarray, right: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of ``n`` draws with replacement how many fall into ``left`` of ``left + right`` equal places; all positive."""
    n, left, right = (np.asarray(x, dtype=np.float64) for x in (n, left, right))
    share = left / (left + right)
    mode = np.minimum(np.floor((n + 1) * share), n)

    def up(rows, k):
        return np.maximum(n[rows, None] - k + 1, 0) * left[rows, None] / (np.maximum(k, 1) * right[rows, None])

    def down(rows, k):
        return np.maximum(k + 1, 0) * right[rows, None] / (np.maximum(n[rows, None] - k, 1) * left[rows, None])

    return _invert(mode.astype(np.int64), np.sqrt(n * share * (1 - share)), u, up, down)


def hypergeometric(good: np.ndarray, bad: np.ndarray, n: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of ``n`` draws without replacement from ``good + bad`` how many are good; all positive, ``n`` below the sum."""
    good, bad, n = (np.asarray(x, dtype=np.float64) for x in (good, bad, n))
    total = good + bad
    mode = np.clip(np.floor((n + 1) * ((good + 1) / (total + 2))), np.maximum(0, n - bad), np.minimum(good, n))
    variance = n * (good / total) * (bad / total) * ((total - n) / np.maximum(total - 1, 1))

    def up(rows, k):
        numerator = np.maximum(good[rows, None] - k + 1, 0) * np.maximum(n[rows, None] - k + 1, 0)
        return numerator / (np.maximum(k, 1) * np.maximum(bad[rows, None] - n[rows, None] + k, 1))

    def down(rows, k):
        numerator = np.maximum(k + 1, 0) * np.maximum(bad[rows, None] - n[rows, None] + k + 1, 0)
        return numerator / (np.maximum(good[rows, None] - k, 1) * np.maximum(n[rows, None] - k, 1))

    return _invert(mode.astype(np.int64), np.sqrt(variance), u, up, down)


def left_draws(n: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Draws (iteration, node) that go to the left halves; the halves (node) hold ``left`` and ``right`` places."""
    out = np.where(right == 0, n, 0)
    i, j = np.nonzero((left > 0) & (right > 0) & (n > 0))
    if len(i):
        out[i, j] = binomial(n[i, j], left[j], right[j], uniform(keys[i], numbers[j]))
    return out


def left_labels(labels: np.ndarray, left: np.ndarray, keys: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    """Labels (iteration, node, class) that go to the ``left`` subjects (node) of each node, class by class."""
    out = np.zeros_like(labels)
    rest = labels.sum(2)
    wanted = np.broadcast_to(left, rest.shape).copy()
    for c in range(labels.shape[2] - 1):
        good = labels[:, :, c]
        rest = rest - good
        dealt = np.where(rest == 0, wanted, np.where(wanted == good + rest, good, 0))
        i, j = np.nonzero((good > 0) & (rest > 0) & (wanted > 0) & (wanted < good + rest))
        if len(i):
            u = uniform(keys[i], node_keys(level, nodes, c)[j])
            dealt[i, j] = hypergeometric(good[i, j], rest[i, j], wanted[i, j], u)
        out[:, :, c] = dealt
        wanted = wanted - dealt
    out[:, :, -1] = wanted
    return out


def pyramid(sizes: np.ndarray, levels: int) -> list[np.ndarray]:
    """Sizes of the nodes of every level over ``1 << levels`` places; the last has one node."""
    out = [np.concatenate([sizes, np.zeros((1 << levels) - len(sizes), sizes.dtype)])]
    for _ in range(levels):
        out.append(out[-1].reshape(-1, 2).sum(1))
    return out


def spread_draws(n: np.ndarray, sizes: np.ndarray, levels: int, keys: np.ndarray, first: int, base: int = 0) -> np.ndarray:
    """``n`` draws of each iteration over places of ``sizes``: (iteration, place). The places begin at ``first`` of the whole tree, whose lowest level is ``base``."""
    whole = pyramid(sizes, levels)
    n = n[:, None]
    for level in range(levels, 0, -1):
        nodes = (first >> level) + np.arange(n.shape[1])
        parts = whole[level - 1].reshape(-1, 2)
        left = left_draws(n, parts[:, 0], parts[:, 1], keys, node_keys(level + base, nodes))
        n = np.stack([left, n - left], axis=2).reshape(len(n), -1)
    return n[:, : len(sizes)]


def spread_labels(labels: np.ndarray, sizes: np.ndarray, levels: int, keys: np.ndarray, first: int) -> np.ndarray:
    """Labels (iteration, class) dealt over places of ``sizes`` subjects: (iteration, place, class)."""
    whole = pyramid(sizes, levels)
    labels = labels[:, None, :]
    for level in range(levels, 0, -1):
        nodes = (first >> level) + np.arange(labels.shape[1])
        left = left_labels(labels, whole[level - 1].reshape(-1, 2)[:, 0], keys, level, nodes)
        labels = np.stack([left, labels - left], axis=2).reshape(len(labels), -1, labels.shape[2])
    return labels[:, : len(sizes)]
