"""Conversation repair against a search over all edits; long conversations in segments; odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from driftpanel.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WANTED = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """Conversation to its rows after damage in the order that the docstring states (ties of a turn: any, if equal)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0)) for c, rs in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append(1 if not end else 2 if (role, text) in seen else 0 if end in ".!?" else 3)
        seen.add((role, text))
    return out


def best_edits(rows, found):
    """Cheapest edits, ties by audit, by Dijkstra over (cost, audit) with whole role strings as far as the pattern needs them."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, settled = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, result = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, result
        if (i, state) in settled:
            continue
        settled.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in follow:
                heapq.heappush(queue, (cost + 5, audit + "I", i, follow[state, role[0]], result + (f"{role}:",)))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, result))
        if found[i] in (1, 2):
            continue
        late = 5 if found[i] == 3 else 0
        if (state, role[:1]) in follow:
            heapq.heappush(queue, (cost + late, audit + "K", i + 1, follow[state, role[:1]], result + (f"{role}:{text}",)))
        for other in ("user", "assistant"):
            if (state, other[0]) in follow:
                heapq.heappush(queue, (cost + 1 + late, audit + "R", i + 1, follow[state, other[0]], result + (f"{other}:{text}",)))


def brute_force(rows):
    out = set()
    for conv, kept in damage(rows).items():
        found = faults(kept)
        cost, audit, result = best_edits(kept, found)
        assert WANTED.fullmatch("".join(r[0] for r in result))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        counts = [found.count(k) for k in (1, 2, 3)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest()))
    return out


def drawn(rng, n_conv, longest, distinct_turns=True):
    rows = []
    for conv in range(n_conv):
        n = rng.randrange(1, longest)
        turns = rng.sample(range(2 * longest), n) if distinct_turns else [rng.choice([None, 1, 2]) for _ in range(n)]
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "User", "ähm"])
            rows.append((conv * 7 - 30, t, role, rng.choice(["a.", "b", " \n", "c!\t", "d? ", None, "…", "e. f", "ü."])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = drawn(random.Random(seed), 400, 12)
    got = {tuple(r) for r in conversations.repaired(spark.createDataFrame(rows, SCHEMA), block_rows=700).collect()}
    assert got == brute_force(rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = [tuple(r) for r in conversations.repaired(table).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversations_are_cut_into_segments(monkeypatch):
    rng = np.random.default_rng(4)
    fault = rng.choice([0, 0, 0, 1, 2, 3], 900)
    initial = rng.choice([ord(c) for c in "suaua x"], 900)
    start, length = np.array([0, 500, 500, 880]), np.array([500, 0, 380, 20])
    whole = conversations.repairs(fault, initial, start, length)
    monkeypatch.setattr(conversations, "SEGMENT", 7)
    for a, b in zip(whole, conversations.repairs(fault, initial, start, length), strict=True):
        assert a[:2] == b[:2] and a[2].tolist() == b[2].tolist()
    rows = [(None, chr(i), "x" if f != 3 else "y") for i, f in zip(initial[880:], fault[880:])]
    cost, audit, _ = best_edits(rows, fault[880:].tolist())
    assert whole[3][:2] == (cost, audit.encode()) and whole[1][:2] == (0, b"")


def test_nulls_repeated_rows_extra_columns_and_no_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (None, 4, "assistant", "y."), (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 2, "", "no role."), (6, None, "user", "z."), (6, None, "user", "z.")]
    table = spark.createDataFrame([r + (1, 2, "x", 3) for r in rows], SCHEMA + ", block long, phase int, fault string, copies long")
    assert {tuple(r) for r in conversations.repaired(table).collect()} == brute_force(rows)
    assert conversations.repaired(table.where("false")).collect() == []


def test_turns_without_order_give_the_same_counts(spark):
    rows = drawn(random.Random(9), 150, 6, distinct_turns=False)
    got = {tuple(r)[:5] for r in conversations.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[:5] for r in brute_force(rows)}


def test_dropped_conversations_are_returned(spark):
    lost = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    got = conversations.repaired(spark.createDataFrame([(c, 0, "user", "a.") for c in lost], SCHEMA)).collect()
    assert {tuple(r) for r in got} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost}


def test_very_long_text_and_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)] + [(2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "ok.")]
    got = {tuple(r) for r in conversations.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_force(rows)
