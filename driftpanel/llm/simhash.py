"""SimHash near-duplicates: pigeonhole blocks of fingerprints, verified by Hamming distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from driftpanel.llm.components import connected_components
from driftpanel.llm.tables import attach, cut_lineage, first_of_groups

SHINGLE = 4
MAX_BITS = 4
#: Larger buckets of distinct fingerprints are linked through Hamming balls instead of one task.
BUCKET_LIMIT = 4096


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    import numpy as np
    import xxhash

    words = text.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    n = len(words)
    if n == 0:
        return 0
    k = min(shingle, n)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    h64 = xxhash.xxh64_intdigest
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((h64(joined[a:b], 42) for a, b in spans), np.uint64, n - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every whole text; null and empty texts give 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint_of(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_masks(n_distinct: int, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks such that two fingerprints within ``max_bits`` agree under at least one of them.

    With ``max_bits + d`` blocks a close pair agrees on ``d`` of them, so every choice of ``d``
    blocks is one mask. More fingerprints take a larger ``d``, so that the expected bucket stays small.
    """
    for d in range(1, 5):
        blocks = max_bits + d
        if n_distinct <= 1 << ((64 // blocks) * d) or d == 4:
            edges = [round(64 * i / blocks) for i in range(blocks + 1)]
            parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
            return [sum(choice) for choice in combinations(parts, d)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps, max_bits: int):
    """Links that span the components of one bucket: each fingerprint is compared once with those not yet reached."""
    import numpy as np

    left, out = fps.copy(), []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            found = left[near]
            if len(found):
                out.append((np.full(len(found), x), found))
                frontier.extend(found)
                left = left[~near]
    return out


def links_in_buckets(combo, key, fps, max_bits: int = MAX_BITS, shifts: int = 24):
    """Links inside the buckets of arrays sorted by (combo, key): all pairs of small buckets, a spanning forest of larger ones."""
    import numpy as np

    n = len(fps)
    if n < 2:
        return np.zeros((2, 0), np.uint64)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (combo[1:] != combo[:-1])])
    size = np.diff(np.r_[start, n])
    out = []
    group = np.repeat(np.arange(len(start)), size)
    small = size[group] <= shifts
    for d in range(1, min(shifts, int(size.max()))):
        pair = (group[d:] == group[:-d]) & small[:-d]
        if not pair.any():
            break
        at = np.flatnonzero(pair)
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= max_bits]
        out.append((fps[at], fps[at + d]))
    for g in np.flatnonzero(size > shifts):
        out += _forest(fps[start[g] : start[g] + size[g]], max_bits)
    return np.array([np.concatenate(x) for x in zip(*out, strict=True)]) if out else np.zeros((2, 0), np.uint64)


def _bucket_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links of the buckets in ``members`` (combo, key, fp); each bucket stays in one task, which streams them in order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if len(now[0]) == 0:
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.argmax(same))
            kept = [x[cut:] for x in now]
            a, b = links_in_buckets(now[0][:cut], now[1][:cut], now[2][:cut].view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        a, b = links_in_buckets(kept[0], kept[1], kept[2].view(np.uint64), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = members.repartition("combo", "key").sortWithinPartitions("combo", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among the rows of ``fps`` without comparing pairs: within ``max_bits`` of each other means that balls of half that radius meet."""
    if max_bits % 2:
        raise ValueError("balls of half the radius need an even number of bits")
    flips = [0] + [_signed(sum(1 << i for i in c)) for r in range(1, (max_bits + 1) // 2 + 1) for c in combinations(range(64), r)]
    near = fps.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    first = near.groupBy("v").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return near.join(first, "v").where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def fingerprint_links(distinct: DataFrame, n_distinct: int, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``a, b``: links that connect just what chains of pairs within ``max_bits`` connect.

    ``distinct`` holds each fingerprint once (``fp``), so copies cost nothing. A bucket of two is
    decided in the aggregation; larger ones are gathered, bounded by ``bucket_limit``; the members
    of still larger ones, all close to each other, go through ``_ball_links``.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(n_distinct, max_bits)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("combo", "mask")).select(
        F.col("combo").cast("long"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    buckets = cut_lineage(
        keyed.groupBy("combo", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where(f"n > 2 or (n = 2 and bit_count(a ^ b) <= {max_bits})")
    )
    pairs = buckets.where("n = 2").select("a", "b")
    middle = keyed.join(buckets.where(f"n > 2 and n <= {bucket_limit}").select("combo", "key"), ["combo", "key"])
    links = pairs.unionByName(_bucket_links(middle, max_bits))
    large = buckets.where(f"n > {bucket_limit}").select("combo", "key")
    if not large.isEmpty():
        links = links.unionByName(_ball_links(keyed.join(large, ["combo", "key"]).select("fp").distinct(), max_bits))
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (needs ``doc_id, text``; other columns are ignored).

    Documents link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is
    the smallest id reachable over links. Equal fingerprints, among them those of all texts without
    words (null, empty, white space: fingerprint 0), are one node. A null id never becomes a
    component's id unless all its ids are null; repeated rows each return a row. An empty table
    gives an empty result.
    """
    printed = cut_lineage(fingerprints(docs, shingle))
    total = printed.count()
    nodes = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    links = fingerprint_links(nodes.select("fp"), nodes.count(), max_bits, bucket_limit)
    linked = cut_lineage(
        connected_components(links).join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "first")
    )
    roots = linked.groupBy("root").agg(F.min("first").alias("smallest"), F.count(F.lit(1)).alias("n"))
    joined = attach(linked.select("fp", "root"), roots, "root", linked.count()).select("fp", "smallest", F.lit(True).alias("is_linked"))
    named = nodes.join(joined, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("smallest")).otherwise(F.col("first")).alias("component_id"), "n")
    return attach(printed, named, "fp", total).select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, that with the smallest id (see ``first_of_groups``); all columns are kept.

    Rows with a null id belong to groups like any other and stay only where no row has an id.
    """
    return first_of_groups(docs, lambda texts: near_duplicates(texts, shingle, max_bits).select("doc_id", "component_id"))
