from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from driftpanel.llm import components, simhash


def plain_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(shingle, len(words))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "a b c", "A b C d", "Ä ß x y z É", "x y " * 40, "w " * 5000, "a\x1cb c d e f"])
def test_fingerprint_equals_plain_definition(text):
    assert simhash.fingerprint_of((text or "").encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same_xxh64(spark):
    text = "the same  bytes"
    got = spark.sql("select xxhash64('the same  bytes') h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("n", [10, 1 << 14, 1 << 21, 1 << 28])
def test_masks_share_a_block_for_every_close_pair(n):
    masks, rng = simhash.block_masks(n), random.Random(n)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(difference & m == 0 for m in masks)


def clustered(seed, n):
    rng, out = random.Random(seed), set()
    centres = [rng.getrandbits(64) for _ in range(n // 8)]
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(5)):
            x ^= 1 << b
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_connect_what_close_pairs_connect(spark, limit):
    fps = clustered(5, 160)
    distinct = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = [(r.a, r.b) for r in simhash.fingerprint_links(distinct, len(fps), bucket_limit=limit).collect()]
    close = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
    assert roots(fps, found) == roots(fps, close)


def test_forest_of_a_large_bucket_is_small():
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 30, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 200).astype(np.uint64)))
    a, b = simhash.links_in_buckets(np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), fps)
    assert len(a) == len(fps) - 1
    assert len(set(roots(fps.tolist(), zip(a.tolist(), b.tolist(), strict=True)).values())) == 1


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(100, i) for i in range(60)] + [(7, 7), (3, None)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)],
        "empty": [],
    }[shape]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)


def test_groups_of_documents(spark, documents):
    long = " ".join(f"word{i}" for i in range(300))
    docs = documents(long, long, "", None, " \n", "quite other words in this one", long.upper(), (None, long, None, None, None), (1, long, "en", "s", 3), extra="fp string, component_id int", values=("clash", 1))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp == 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, False, 0), (0, False, 0), (1, False, 0), (1, False, 0), (2, True, 2), (3, True, 2), (4, True, 2), (5, False, 5), (6, False, 0)]


def test_one_document_of_each_group_stays(spark, documents):
    long = " ".join(f"word{i}" for i in range(300))
    near = long.replace("word150", "changed")
    docs = documents(long, near, "quite other words in this one", long, (0, long, "en", "s", len(long)), extra="bits string", values=("x",))
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert simhash.first_of_each_group(docs.limit(0)).count() == 0


def test_hot_group_of_near_copies_is_linked_without_all_pairs(spark, documents):
    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 400, 4)]
    groups = simhash.near_duplicates(documents(*texts, "another text"))
    got = {r.doc_id: (r.fp, r.component_id) for r in groups.collect()}
    fps = [plain_fingerprint(t) for t in [*texts, "another text"]]
    close = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots(range(len(fps)), close)
    assert {i: c for i, (_, c) in got.items()} == want
