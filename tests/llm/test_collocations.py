"""Collocations against plain counting of all phrases, with groups and runs small enough to lengthen prefixes."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from driftpanel.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    around = Counter()
    for (lang, p), a in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                key = lang, p[i : i + size]
                around[key] = max(around[key], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * around[lang, p] >= 80 * a:
            continue
        sums = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(sums)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for lang, c in sorted(out.items()) for i, (score, a, p, left, right) in enumerate(sorted(c)[:top], 1)]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["the"] * 12 + [f"w{i}" for i in range(12)] + ["Of", "É", "don't", "of the", "new york city", "in spite of", "x\x1cy", "rare%d"]
    rows = []
    for _ in range(n):
        text = "".join((w % rng.randrange(10**6) if "%d" in w else w) + rng.choice([" "] * 12 + ["\t ", ". ", ",", "\n", "! ", "\r\n", "; "]) for w in rng.choices(words, k=rng.randrange(200)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("de", ""), (None, " . \t"), ("en", "new york city " * 40), ("xx", "only once here")]


@pytest.mark.parametrize("group, chunk", [(1 << 20, 1 << 20), (150, 400), (20, 50)])
def test_equals_plain_counting(spark, group, chunk):
    rows = made(group)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(collocations.collocations(docs, least=5, group_suffixes=group, chunk=chunk)) == sorted(brute_force(rows, 5))


def test_top_breaks_ties_by_bytes(spark):
    rows = [("en", "b é. b z. b a. a b. aa b")] * 6
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(collocations.collocations(docs, least=5, top=3))
    assert got == sorted(brute_force(rows, 5, top=3)) and len(got) == 3


def test_long_texts_are_cut_at_words_only(monkeypatch):
    text = ("ab cd, ef\tgh. " * 50 + "x" * 300 + " end").encode()
    whole = sum(collocations.split_words([text, b"", text]), [])
    for size in (1, 7, 100):
        assert sum(collocations.split_words([text, b"", text], size), []) == whole
    assert whole[:6] == [b"ab", b"cd", b".", b"ef", b"gh", b"."]


def test_a_full_table_of_words_cuts_no_phrase(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice(["a b c", "d", f"r{rng.randrange(10**6)}"]) for _ in range(300))) for _ in range(10)]
    monkeypatch.setattr(collocations, "HELD_WORDS", 40)
    batches = lambda: iter([__import__("pyarrow").RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})])
    bits = b"\xff" * (1 << collocations.FILTER_BITS >> 3)
    monkeypatch.setattr(collocations, "SLICE", 500)
    found = Counter()
    for _, words, ids in collocations._chunks(batches(), 0, bits, 100):
        names = {h: w for w, h in zip(words.index, words.hashes.tolist(), strict=False)}
        columns, n = collocations._suffixes(words, ids)
        for *hashes, k in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
            found[tuple(names[h] for h in hashes if h)] += k
    want = Counter()
    for _, text in rows:
        w = text.encode().split()
        want.update(tuple(w[i : i + 4]) for i in range(len(w) - 1))
    assert found == want


def test_groups_stay_within_the_budget():
    rng = np.random.default_rng(1)
    plan = collocations.Plan(256)
    loads = rng.integers(0, 50, 256)
    loads[7] = 5000
    plan.add(loads, 100)
    sizes = np.bincount(plan.bands[0][plan.bands[0] >= 0], weights=loads[plan.bands[0] >= 0])
    assert sizes.max() <= 200 and plan.bands[0][7] == -1 and plan.length(0) == 1


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string, n long")).collect() == []
