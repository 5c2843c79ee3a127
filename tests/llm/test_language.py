from __future__ import annotations

import binascii
import random
from itertools import combinations

import numpy as np
import pytest

from driftpanel.llm import language

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "bab", "c"]


@pytest.fixture(scope="module")
def table():
    return language.PieceTable(PIECES)


def by_enumeration(word, table, probs):
    """Sum over all segmentations of the marked word, one by one."""
    total = np.zeros(probs.shape[1])
    row = {p: i for i, p in enumerate(table.pieces)}
    for r in range(len(word)):
        for cuts in combinations(range(1, len(word)), r):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]
            if any(p not in row and len(p) > 1 for p in parts):
                continue
            total += np.prod([probs[row.get(p, len(table.pieces))] for p in parts], axis=0)
    return total


def test_forward_sums_all_segmentations(table):
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((len(PIECES) + 1, 3)) * 0.1, np.zeros(3)])
    for word in ("a", "ab", "bab", "abab", "zab", "bcxba", "ababbab"):
        got = np.exp(language.log_words([word], table, probs)[0])
        assert got == pytest.approx(by_enumeration("▁" + word, table, probs), rel=1e-9)


def test_expected_counts_are_derivatives(table):
    """The expected uses of a piece are p * d log P / dp."""
    rng = np.random.default_rng(2)
    probs = np.vstack([rng.random((len(PIECES) + 1, 1)) * 0.1, np.zeros(1)])
    words, weights = ["abab", "ba", "zab"], np.array([[2.0], [1.0], [3.0]])
    counts = language.expected_counts(words, weights, table, probs)
    for k in range(len(PIECES) + 1):
        moved = probs.copy()
        moved[k] *= 1 + 1e-6
        slope = ((language.log_words(words, table, moved) - language.log_words(words, table, probs)) * weights).sum() / 1e-6
        assert counts[k, 0] == pytest.approx(slope, abs=1e-4)


def test_long_and_mixed_words():
    assert language.parts_of("ab½c") == ["▁abc"]
    assert "".join(language.parts_of("x" * 100)) == "▁" + "x" * 100
    assert language.parts_of("½") == []


def invented(seed, n=240):
    rng = random.Random(seed)
    syllables = {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ber", "zü"], "zz": ["ción", "ñe", "lla", "os"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(2, 60))), lang, "s", 0))
    return rows


def test_held_out_accuracy_and_contract(spark, documents):
    rows = invented(3)
    odd = [(1000, None, "xx", "s", None), (1001, "123 ½ !!", "yy", "s", 0), (1002, "KATO mire", None, None, None), (None, "schung ber", None, None, None), (1003, "kato " * 30000, None, None, 1)]
    docs = documents(*rows, *odd, extra="score string, lang_pred int", values=("x", 1)).repartition(3)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert all(got[i].held_out == (binascii.crc32(str(i).encode()) % 3 == 1) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 40 and sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert (got[1000].lang_pred, got[1000].score, got[1001].lang_pred) == ("und", 0.0, "und")
    assert (got[1002].lang_pred, got[None].lang_pred, got[None].held_out, got[1003].lang_pred) == ("xx", "yy", False, "xx")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_documents_teach_nothing(spark, documents):
    rows = invented(4, 90)
    swapped = [(i, t, "qq" if binascii.crc32(str(i).encode()) % 3 == 1 else lang, s, n) for i, t, lang, s, n in rows]
    first = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents(*rows)).collect()}
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents(*swapped)).collect()}
    assert first == again


def test_rejected_documents_go_and_columns_stay(spark, documents):
    docs = documents(*invented(5, 60), (900, None, None, None, None), (901, "42 !!", "xx", None, 5), extra="row string", values=("x",))
    kept = language.identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert language.identified(docs.limit(0)).count() == 0
    nothing = language.identify(documents(("x", "x", None, "s", 1)[0:0] or (1, "kato", None, "s", 4))).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
