from __future__ import annotations

import hashlib
import random

import pytest

from driftpanel.llm import substrings


def brute(rows, window=13):
    """doc_id, n_words, n_removed, digest by comparing every window with every smaller id."""
    last = (1 << 63) - 1
    words = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, last), i)
    out = []
    for (i, w), (real, _) in zip(words, rows, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((real, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=4, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", " x", "a\x1cb"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(10, 70))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append(rng.choice([" ", "\n", "\t\x0b "]).join(parts))
    return [*texts, texts[3], texts[3], "ha " * 500, "ha " * 700, "", None, " \n ", "short one"]


@pytest.mark.parametrize("limits", [{}, {"chunk_windows": 50, "bucket_bytes": 300}])
def test_equals_brute_force(spark, documents, limits):
    rows = [(i, t) for i, t in enumerate(corpus())] + [(None, corpus()[0]), (5, corpus()[9]), (3, corpus()[3])]
    docs = documents(*[(i, t, None, None, None) for i, t in rows], extra="hashes string, found int, kept int", values=("x", 1, 2)).repartition(5)
    got = substrings.trimmed(docs, **limits)
    got = [(r.row.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_digests_equal_brute_force(spark, documents):
    rows = list(enumerate(corpus(8, 20)))
    got = [tuple(r) for r in substrings.digests(documents(*[t for _, t in rows])).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_intervals_are_maximal(spark, documents):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = documents(passage, f"a b {passage} c", f"{passage} {passage}")
    got = {r.row.doc_id: [(x.first, x["after"]) for x in r.removed] for r in substrings.trimmed(docs).collect()}
    assert got == {0: [], 1: [(2, 32)], 2: [(0, 60)]}


def test_texts_without_repeats_keep_their_layout(spark, documents):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(passage, "two  lines\n here", f"own words {passage}", passage, None, "", extra="row string", values=("x",))
    kept = substrings.kept_texts(docs, window=50)
    assert kept.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert got == {0: (passage, len(passage)), 1: ("two  lines\n here", 16), 2: ("own words", 9), 4: (None, None), 5: ("", 0)}


def test_empty_table(spark, documents):
    assert substrings.digests(documents("x").limit(0)).count() == 0
    assert substrings.kept_texts(documents("x").limit(0)).count() == 0
