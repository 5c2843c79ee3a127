from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from driftpanel.llm import mixing


def water_fill(sizes: dict, most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in stopped else target[s] for s in names}
        stopped |= over


def hash60(doc_id):
    return int(hashlib.md5(str("null" if doc_id is None else doc_id).encode()).hexdigest()[:15], 16)


def brute(rows):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t, _) in enumerate(rows)}
    by_source = defaultdict(int)
    for k, (_, _, s) in enumerate(rows):
        by_source[s] += size[k]
    targets = water_fill(by_source)
    out = []
    for s, total in by_source.items():
        mine = defaultdict(int)
        for k, (i, _, source) in enumerate(rows):
            if source == s:
                mine[hash60(i)] += size[k]
        whole = int(targets[s] // total) if total else 0
        need, upto, taken = targets[s] - whole * total, 0, set()
        for h in sorted(mine):
            if upto >= need:
                break
            if upto + mine[h] < need or upto + mine[h] - need < need - upto:
                taken.add(h)
            upto += mine[h]
        out += [(i, size[k], total, round(targets[s], 6), (whole + (hash60(i) in taken)) * size[k]) for k, (i, _, source) in enumerate(rows) if source == s]
    return sorted(out, key=str)


def rows_of(seed, n=300, sources=5):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(sources)] + ["S", "é", None, ""]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 30, 400])), rng.choice([names[0]] * 4 + names)) for i in range(n)]
    return [*rows, (None, "a b c", "s0"), (7, "a b c", "s1"), (8, None, "s1"), (n, "", "only empty")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sorting_by_hash(spark, documents, seed):
    rows = rows_of(seed)
    docs = documents(*[(i, t, None, s, None) for i, t, s in rows], extra="size string, hash int, target int", values=("x", 1, 2)).repartition(4)
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_targets_are_met_and_reruns_agree(spark, documents):
    rows = rows_of(3, 600)
    docs = documents(*[(i, t, None, s, None) for i, t, s in rows])
    first, again = [sorted(map(tuple, mixing.mix(docs.repartition(p)).collect()), key=str) for p in (2, 7)]
    assert first == again
    taken, target = defaultdict(int), {}
    for (_, size, source_size, goal, copies, words), in zip(first, strict=True):
        taken[source_size, goal] += words
        target[source_size, goal] = goal
        assert words == copies * size and words <= 3 * size
    assert all(abs(taken[k] - target[k]) <= 200 for k in target)
    assert sum(taken.values()) == pytest.approx(sum(len((t or "").split()) for _, t, _ in rows), abs=1000)


def test_one_source_and_empty_tables(spark, documents):
    got = [r.taken for r in mixing.mix(documents("a b", "c", None)).collect()]
    assert sorted(got) == [0, 1, 2]
    assert mixing.mix(documents("a").limit(0)).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(documents("", None)).collect()] == [(0, 0.0, 0)] * 2


def test_many_hash_levels_separate_close_hashes(spark, monkeypatch):
    sizes = spark.createDataFrame([("s", 5, 10), ("s", 6, 10), ("s", 7, 10), ("t", 1 << 59, 4)], "source string, hash long, size long")
    wanted = spark.createDataFrame([("s", 30, 14.0), ("t", 4, 9.0)], "source string, source_size long, target double")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = {r.source: (r.copies, r.below) for r in mixing.thresholds(sizes, wanted).collect()}
    assert got == {"s": (0, 6), "t": (2, 1 << 59)}
