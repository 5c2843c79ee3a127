from __future__ import annotations

import numpy as np
import pytest

from driftpanel.llm import decontaminate, simhash, simhash_wide
from tests.llm.test_simhash import roots


def template_group(seed, n, pairs, flips=0.125, apart=0.1):
    """Fingerprints of a template group, mostly too far apart to link, and of planted near copies of its first members."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, 1024, dtype=np.uint8)
    bits = base ^ (rng.random((n, 1024)) < flips)
    bits = np.vstack([bits, bits[:pairs] ^ (rng.random((pairs, 1024)) < apart)]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_by_brute_force(fps, most):
    return [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]).sum(axis=1, dtype=int) <= most)]


def groups_of(spark, monkeypatch, fps, **options):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(fps.view(np.int64).tolist())], "doc_id long, fp array<long>")
    monkeypatch.setattr(simhash_wide, "wide_fingerprints", lambda docs, shingle: docs)
    return {r.doc_id: r.component_id for r in simhash_wide.similar_groups(table, **options).collect()}


def test_planted_pairs_in_a_template_group(spark, monkeypatch):
    n, pairs = 2000, 200
    fps = template_group(1, n, pairs)
    got = groups_of(spark, monkeypatch, fps)
    want = roots(range(len(fps)), close_by_brute_force(fps, simhash_wide.most_bits(0.8)))
    planted = [i for i in range(pairs) if want[i] == want[n + i]]
    assert len(planted) > 190 and len(set(want.values())) > n / 2
    assert [i for i in planted if got[i] != got[n + i]] == []


@pytest.mark.parametrize("n", [20, 26, 40, 200, 700])
def test_pair_of_a_bucket_whose_previews_are_all_close(n):
    import pyarrow as pa

    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, (n, simhash_wide.WORDS)).astype(np.uint64)
    fps[:, [3, 10]] = fps[0, [3, 10]]
    fps[7] = fps[12] ^ np.uint64(1)
    node = np.arange(n) + 100
    columns = {"bucket": np.full(n, 5), "turn": np.arange(n), "node": node, "first": fps[:, 3].view(np.int64), "second": fps[:, 10].view(np.int64), "root": node}
    rows = [r for out in simhash_wide._near_in_buckets(31)([pa.RecordBatch.from_pydict(columns)]) for r in out.to_pylist()]
    dense = [r["a"] - 100 for r in rows if r["b"] is None]
    found = {(r["a"], r["b"]) for r in rows if r["b"] is not None}
    if dense:
        a, b = simhash_wide.spanning_forest(fps[dense], simhash_wide.most_bits(0.8))
        found |= {(dense[x] + 100, dense[y] + 100) for x, y in zip(a, b, strict=True)}
    assert (107, 112) in found and len(found) <= 12 * n


@pytest.mark.parametrize("n", [12_000, 1 << 18, 1 << 24, 1 << 28])
def test_pairs_meet_at_every_number_of_documents(n):
    import pyarrow as pa

    rng, pairs = np.random.default_rng(3), 1000
    a = rng.integers(0, 2, (pairs, 1024), dtype=np.uint8)
    b = a ^ (rng.random((pairs, 1024)) < simhash_wide.expected_share(0.8))
    bits = simhash_wide.block_bits(n)
    both = np.packbits(np.vstack([a, b]), axis=1, bitorder="little").view(np.int64)
    batch = pa.RecordBatch.from_pydict({"node": np.arange(2 * pairs), "fp": pa.array(both.tolist(), pa.list_(pa.int64())), "root": np.arange(2 * pairs)})
    run = simhash_wide._blocks(bits, simhash_wide.block_count(bits, 0.8))
    buckets = [set() for _ in range(2 * pairs)]
    for out in run([batch]):
        for bucket, node in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True):
            buckets[node].add(bucket)
    assert sum(bool(buckets[i] & buckets[pairs + i]) for i in range(pairs)) >= 0.99 * pairs


def test_pairs_grow_with_members_not_with_the_square(spark, monkeypatch):
    """A group of near copies, each close to each: the pairs that are looked up whole stay below the members times the first blocks, twice."""
    n = 1500
    fps = template_group(5, n, 0, flips=0.03)
    seen = []
    verified = simhash_wide._verified
    monkeypatch.setattr(simhash_wide, "_verified", lambda candidates, nodes, most: seen.append(candidates.count()) or verified(candidates, nodes, most))
    got = groups_of(spark, monkeypatch, fps)
    assert set(got.values()) == {0} and sum(seen) <= 2 * simhash_wide.FIRST_BLOCKS * n


@pytest.mark.parametrize("held", [1 << 18, 300])
def test_a_large_bucket_of_one_component_and_a_few_others(monkeypatch, held):
    import pyarrow as pa

    monkeypatch.setattr(simhash_wide, "HELD", held)
    n = 5000
    fps = np.vstack([template_group(7, n, 0, flips=0.02), np.random.default_rng(8).integers(0, 1 << 63, (4, 16)).astype(np.uint64)])
    fps[n + 3] = fps[17] ^ np.uint64(3)
    root = np.r_[np.zeros(n, np.int64), np.arange(1, 5)]
    turn = np.random.default_rng(9).permutation(n + 4)
    columns = {"bucket": np.full(n + 4, 5), "node": np.arange(n + 4)[turn], "first": fps[turn, 3].view(np.int64), "second": fps[turn, 10].view(np.int64), "root": root[turn]}
    batches = pa.Table.from_pydict(columns).to_batches(max_chunksize=700)
    rows = [r for out in simhash_wide._near_in_buckets(31)(iter(batches)) for r in out.to_pylist()]
    if held < n:
        assert sorted(r["a"] for r in rows if r["b"] is None) == list(range(n + 4))
    else:
        assert len(rows) == n and {(r["a"], r["b"]) for r in rows} == {(i, n + 3) for i in range(n)}  # no pair within the component


def test_first_links_are_close_and_one_a_member():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    fps = template_group(6, 300, 0, flips=0.02)
    bucket = np.sort(rng.integers(0, 4, 300))
    columns = {"bucket": bucket, "node": np.arange(300), "first": fps[:, 3].view(np.int64), "second": fps[:, 10].view(np.int64)}
    links = [tuple(r.values()) for out in simhash_wide._first_links(31)([pa.RecordBatch.from_pydict(columns)]) for r in out.to_pylist()]
    assert len({b for _, b in links}) == len(links) == 300 - len(set(bucket.tolist()))
    assert all(bucket[a] == bucket[b] and a < b for a, b in links)


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    fps = template_group(2, 600, 60)
    got = groups_of(spark, monkeypatch, fps, part=8)
    close = close_by_brute_force(fps, simhash_wide.most_bits(0.8))
    met = [set(x.tolist()) for x in simhash_wide.block_values(fps, 14, 66) * np.uint64(66) + np.arange(66, dtype=np.uint64)]
    want = roots(range(len(fps)), [(i, j) for i, j in close if met[i] & met[j]])
    assert got == want


def test_rows_with_null_or_shared_ids_are_judged_one_by_one(spark, documents):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    row = lambda i, k: (i, words(k), "en", "s", 3)
    docs = documents(row(None, 1), row(None, 2), row(5, 3), row(5, 4), row(1, 4), row(None, 4), row(5, 3), row(None, 2), extra="key string, id string", values=("x", "y"))
    want = sorted([(-1, words(1)), (-1, words(2)), (5, words(3)), (1, words(4))])
    for module in (simhash_wide, simhash):
        got = module.first_of_each_group(docs)
        assert got.columns == docs.columns
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got.collect()) == want
    items = spark.createDataFrame([(0, words(2)), (1, words(3))], "item_id long, text string")
    left = decontaminate.without_benchmark(docs, items)
    assert left.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in left.collect()) == sorted([(-1, words(1)), (5, words(4)), (1, words(4)), (-1, words(4))])
