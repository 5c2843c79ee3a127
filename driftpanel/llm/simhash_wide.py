"""SimHash at a stated similarity: long fingerprints of word shingles, joined on blocks, verified by Hamming distance.

Fingerprints of 64 bits that differ in a few bits find only nearly equal texts. To find pairs of a
Jaccard similarity of 0.8 over word shingles, whose fingerprints differ in about 15 % of the bits,
these have 1,024 bits, 66 or more blocks of bits drawn from all of them, and a distance that stands
for the similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from driftpanel.llm.components import connected_components
from driftpanel.llm.tables import attach, cut_lineage, first_of_groups

WORDS = 16
BITS = 64 * WORDS
#: Share of the pairs at the stated similarity that have a block in common, whatever the number of texts.
MEET = 0.999
SHINGLE = 5
SIMILARITY = 0.8
#: Deviations that the accepted distance lies above what the similarity makes expect: 0.93 of the pairs at exactly it are accepted.
SLACK = 1.5
#: Blocks of the first round, and members of a bucket that one looks back for a partner there.
FIRST_BLOCKS = 3
LOOK_BACK = 128
#: Members of one bucket that a task holds on two words, and comparisons of two words that it makes for one bucket.
HELD = 1 << 18
COMPARED = 1 << 28
#: Members of one bucket whose whole fingerprints are compared together; larger buckets are dealt into such parts.
PART = 4096
#: Of the two fingerprint words that travel with a block, as many bits may differ before the rest is looked at (3 deviations).
PREVIEW_SLACK = 3.0
ODD = 0x9E3779B97F4A7C15


def expected_share(similarity: float) -> float:
    """Share of differing bits of two equally large shingle sets of a Jaccard similarity: the angle over pi."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def most_bits(similarity: float, bits: int = BITS, slack: float = SLACK) -> int:
    """Accepted distance: what the similarity makes expect, and so many standard deviations more."""
    p = expected_share(similarity)
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def shingle_hashes(text: bytes, shingle: int = SHINGLE):
    """Distinct XXH64 hashes of the word shingles of a text (ASCII letters lower-cased); the whole sequence if it is shorter."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    k = min(shingle, len(words))
    grams = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else ()
    return np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))


def _mixed(hashes, words: int = WORDS):
    """Independent fingerprint words of every hash: array (hash, word)."""
    import numpy as np

    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(ODD)
    x = hashes[:, None] + steps[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def majority(rows):
    """Bits that are set in over half the rows of (row, word); 255 rows at a time are added in single bytes."""
    import numpy as np

    n, width = rows.shape
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, n, 255):
        bits = np.unpackbits(rows[at : at + 255].view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def wide_fingerprint(text: bytes, shingle: int = SHINGLE):
    import numpy as np

    hashes = shingle_hashes(text, shingle)
    return majority(_mixed(hashes)) if len(hashes) else np.zeros(WORDS, np.uint64)


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (array of 16 longs) of every whole text; all bits are 0 without words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [wide_fingerprint(t.as_py() or b"", shingle).view(np.int64) for t in texts]
            flat = pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64), pa.int64())
            offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp array<long>")


def block_bits(n: int) -> int:
    """Bits of a block, so that about 64 texts meet in a bucket by chance; never under 14."""
    return min(max(math.ceil(math.log2(max(n, 2))) - 6, 14), 32)


def block_count(bits: int, similarity: float) -> int:
    """So many blocks that a pair of the similarity has one in common with probability ``MEET``."""
    return math.ceil(math.log(1 - MEET) / math.log(1 - (1 - expected_share(similarity)) ** bits))


def block_values(fps, bits: int, count: int):
    """Values of ``count`` blocks, each of ``bits`` bits drawn from the whole fingerprint: array (row, block)."""
    import numpy as np

    rng = np.random.default_rng(ODD)
    places = np.array([rng.choice(BITS, bits, replace=False) for _ in range(count)])
    unpacked = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    values = np.zeros((len(fps), count), np.uint64)
    for k in range(bits):
        values |= unpacked[:, places[:, k]].astype(np.uint64) << np.uint64(k)
    return values


def _blocks(bits: int, count: int):
    """``node, fp, root`` to ``bucket, turn, node, first, second, root``: block number and value, an order that differs by block, two fingerprint words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["bucket", "turn", "node", "first", "second", "root"]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                nodes, roots = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 2))
                fps = _fingerprints_of(batch.column(1))
                values = block_values(fps, bits, count)
                number = np.arange(count, dtype=np.uint64)
                bucket = values * np.uint64(count) + number
                turn = (nodes[:, None] ^ (number * np.uint64(ODD))) * np.uint64(0x94D049BB133111EB)
                flat = lambda x: pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))
                wide = np.broadcast_to
                yield pa.RecordBatch.from_arrays(
                    [flat(bucket), flat(turn), *[flat(wide(c[:, None], values.shape)) for c in (nodes, fps[:, 3], fps[:, 10], roots)]], names
                )

    return run


def _first_links(limit: int):
    """Buckets that arrive in order to ``a, b``: each member and the nearest before it that is close on two words, one pair a member at most.

    A large group of near copies becomes few components this way, so that the round over all blocks does
    not meet its pairs. What is missed here is found there.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bucket, node, first, second = (batch.column(n).to_numpy() for n in ("bucket", "node", "first", "second"))
            first, second = first.view(np.uint64), second.view(np.uint64)
            linked = np.zeros(len(bucket), bool)
            pairs = [np.zeros((0, 2), np.int64)]
            for d in range(1, min(LOOK_BACK, len(bucket) - 1) + 1):
                same = bucket[d:] == bucket[:-d]
                if not same.any():
                    break
                later = np.flatnonzero(same & ~linked[d:]) + d
                apart = np.bitwise_count(first[later] ^ first[later - d]).astype(np.int16) + np.bitwise_count(second[later] ^ second[later - d])
                later = later[apart <= limit]
                linked[later] = True
                x, y = node[later], node[later - d]
                pairs.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
            a, b = np.concatenate(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _near_in_buckets(limit: int):
    """Buckets that arrive in order to ``bucket, a, b``: close pairs of the previews (no bucket), or the members of a dense bucket (no ``b``)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(rows, cut):
            bucket, node, first, second, root = rows
            a, b, dense = close_pairs(bucket, first, second, root, limit, cut)
            x, y = node[a], node[b]
            pair = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            none = np.r_[np.ones(len(pair), bool), np.zeros(len(dense), bool)]
            columns = [
                pa.array(np.r_[np.zeros(len(pair), np.int64), bucket[dense]], mask=none),
                pa.array(np.r_[pair[:, 0], node[dense]]),
                pa.array(np.r_[pair[:, 1], np.zeros(len(dense), np.int64)], mask=~none),
            ]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "a", "b"])

        kept, cut = [np.zeros(0, np.int64)] * 5, None
        for batch in batches:
            new = [batch.column(n).to_numpy() for n in ("bucket", "node", "first", "second", "root")]
            now = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if not len(now[0]):
                continue
            start = len(now[0]) - int(np.argmax(now[0][::-1] != now[0][-1])) if (now[0] != now[0][-1]).any() else 0
            full = len(now[0]) - start if len(now[0]) - start >= HELD else 0
            kept = [x[start + full :] for x in now]
            if start:
                yield links([x[:start] for x in now], cut)
            if full:
                # A bucket of this many members is dense anyhow, its rows can go on.
                cut = int(now[0][-1])
                yield links([x[start : start + full] for x in now], cut)
        if len(kept[0]):
            yield links(kept, cut)

    return run


def close_pairs(bucket, first, second, root, limit: int, cut: int | None = None, shifts: int = 128):
    """Positions of all pairs of different roots within ``limit`` bits on two words, and of the members of dense buckets, whose pairs are left out.

    In a large bucket the members outside its most frequent root are compared with all others, the members of that root
    not with each other. Dense are buckets of ``HELD`` members or more, the bucket ``cut``, buckets that would take over
    ``COMPARED`` comparisons or has over 12 close pairs a member. Of a bucket with more pairs than members in them those members
    are returned instead of the pairs.
    """
    import numpy as np

    first, second = first.view(np.uint64), second.view(np.uint64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[start, len(bucket)])
    group = np.repeat(np.arange(len(start)), size)
    dense = (size >= HELD) | (bucket[start] == cut if cut is not None else False)
    small = (size <= shifts) & ~dense
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    near = lambda x, y: np.bitwise_count(first[x] ^ first[y]).astype(np.int16) + np.bitwise_count(second[x] ^ second[y]) <= limit
    within = lambda x, y: near(x, y) & (root[x] != root[y])
    members = np.flatnonzero(small[group])
    for d in range(1, int(size[small].max(initial=1))):
        members = members[(members + d < len(group))]
        members = members[group[members + d] == group[members]]
        at = members[within(members, members + d)]
        a.append(at)
        b.append(at + d)
    for g in np.flatnonzero(~small & ~dense):
        every = np.arange(start[g], start[g] + size[g])
        names, counts = np.unique(root[every], return_counts=True)
        main = root[every] == names[np.argmax(counts)]
        others = every[~main]
        if len(others) * size[g] > COMPARED:
            dense[g] = True
            continue
        # the main members first: each other member meets them and the others before it
        line = np.r_[every[main], others]
        x, y, n = [], [], 0
        for k, i in enumerate(others.tolist(), start=int(main.sum())):
            found = line[:k][within(i, line[:k])]
            x.append(np.full(len(found), i))
            y.append(found)
            n += len(found)
            if n > 12 * size[g]:
                dense[g] = True
                break
        else:
            a += x
            b += y
    a, b = np.concatenate(a), np.concatenate(b)
    met = np.zeros(len(group), bool)
    met[a] = met[b] = True
    # more pairs than members that have one: their whole fingerprints are compared, the others have no close partner
    several = np.bincount(group[a], minlength=len(start)) > np.bincount(group[met], minlength=len(start))
    sparse = ~(dense | several)[group[a]]
    return a[sparse], b[sparse], np.flatnonzero(dense[group] | (several[group] & met))


def _fingerprints_of(column):
    import numpy as np

    return column.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def spanning_forest(fps, most: int):
    """Positions of links that span the components of (row, word) under whole distances of at most ``most`` bits."""
    import numpy as np

    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.arange(len(fps))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(axis=1, dtype=np.int32) <= most
            found = left[near]
            a.append(np.full(len(found), x))
            b.append(found)
            frontier.extend(found.tolist())
            left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def _forests(most: int):
    """``bucket, part, node, fp`` in order of bucket and part to links by whole distances that span each part's components."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(rows):
            bucket, piece, node, fps = rows
            start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1])])
            pairs = [np.zeros((2, 0), np.int64)]
            for at, end in zip(start, np.r_[start[1:], len(bucket)], strict=True):
                a, b = spanning_forest(fps[at:end], most)
                pairs.append(np.stack([node[at + a], node[at + b]]))
            x, y = np.concatenate(pairs, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*[batch.column(i).to_numpy() for i in range(3)], _fingerprints_of(batch.column(3))]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            other = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
            start = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            kept = [x[start:] for x in now]
            if start:
                yield links([x[:start] for x in now])
        if kept is not None:
            yield links(kept)

    return run


def _dealt(dense: DataFrame, nodes: DataFrame, part: int) -> DataFrame:
    """``bucket, part, parts, n, node, fp`` of the members of dense buckets, in parts of about ``part``."""
    counts = dense.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("bucket", "n", F.col("n").alias("members"), F.ceil(F.col("n") / part).alias("parts"))
    members = attach(dense, counts, "bucket", dense.count())
    piece = F.pmod(F.xxhash64("bucket", "node"), F.col("parts"))
    return members.withColumn("part", piece).join(nodes.select("node", "fp"), "node").select("bucket", "part", "parts", "members", "node", "fp")


def _crossings(most: int):
    """``bucket, part, probe, node, root, fp`` in order of bucket, part and probe: links of probes with the part's members of other roots, one for each root."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, nodes, roots, fps, stale = None, [], [], [], True
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            probe, node, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            rows, pairs = _fingerprints_of(batch.column(5)), [np.zeros((2, 0), np.int64)]
            for i, key in enumerate(keys):
                if key != now:
                    now, nodes, roots, fps = key, [], [], []
                if not probe[i]:
                    nodes.append(node[i])
                    roots.append(root[i])
                    fps.append(rows[i])
                    stale = True
                    continue
                if stale:
                    members = np.array(nodes, np.int64), np.array(roots, np.int64), np.array(fps, np.uint64).reshape(-1, WORDS)
                    stale = False
                near = np.bitwise_count(members[2] ^ rows[i]).sum(axis=1, dtype=np.int32) <= most
                near = np.flatnonzero(near & (members[1] != root[i]))
                if len(near):
                    _, first = np.unique(members[1][near], return_index=True)
                    other = members[0][near[first]]
                    pairs.append(np.stack([np.minimum(other, node[i]), np.maximum(other, node[i])]))
            x, y = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def _links_across_parts(members: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Links between the parts of large buckets, so that with the links inside parts each bucket is compared whole.

    ``known`` has the groups (``node, root``) that other links make. Members of a bucket's largest
    group need not be compared with each other: the others are, with every part.
    """
    rooted = members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut_lineage(rooted)
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"), F.first("members").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.first("n").alias("n"))
    others = attach(rooted, largest, "bucket", rooted.count()).where("root != main")
    probes = others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ["bucket", "part", "probe", "node", "root", "fp"]
    both = rooted.withColumn("probe", F.lit(False)).select(columns).unionByName(probes.withColumn("probe", F.lit(True)).select(columns))
    dealt = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "probe")
    return dealt.mapInArrow(_crossings(most), "a long, b long").distinct()


def _verified(candidates: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs ``a, b`` whose whole fingerprints differ in at most ``most`` bits."""
    ends = nodes.select("node", "fp")
    both = candidates.join(ends.withColumnsRenamed({"node": "a", "fp": "fp_a"}), "a").join(ends.withColumnsRenamed({"node": "b", "fp": "fp_b"}), "b")
    distance = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(distance <= most).select("a", "b")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """``doc_id, component_id`` of every row: groups of texts that chains of similar pairs connect.

    Pairs link when their 1,024-bit fingerprints differ in no more bits than the similarity makes
    expect and 1.5 deviations. They are found on blocks whose number follows from their bits, so
    that a pair of the stated similarity shares at least one with probability ``MEET`` at every
    number of documents. The distance is an estimate: about 0.93 of the pairs at exactly the
    similarity are accepted, and a third of those at 0.75. Equal texts are one node. A first round over few blocks
    links each member to one close predecessor; the round over all blocks then looks at pairs of different
    components only, so pairs grow with members, not with the square of a group. Where many members of a bucket are
    close on two words, whole fingerprints link them. A bucket of over ``part`` members is dealt into parts;
    members outside its largest group are then compared with all the parts. Texts without words
    (null, empty) are one group; null ids and repeated rows are rows like any other, and a null id
    names a group only if all its ids are null. An empty table gives an empty result.
    """
    printed = cut_lineage(wide_fingerprints(docs, shingle).withColumn("node", F.xxhash64("fp")))
    total = printed.count()
    nodes = cut_lineage(printed.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")))
    bits = block_bits(nodes.count())
    p = expected_share(similarity)
    limit = math.floor(128 * p + PREVIEW_SLACK * math.sqrt(128 * p * (1 - p)))
    most = most_bits(similarity)

    def in_buckets(rooted: DataFrame, count: int) -> DataFrame:
        blocks = rooted.select("node", "fp", "root").mapInArrow(_blocks(bits, count), "bucket long, turn long, node long, first long, second long, root long")
        return blocks.repartition("bucket").sortWithinPartitions("bucket", "turn")

    first = in_buckets(nodes.withColumn("root", F.col("node")), FIRST_BLOCKS).mapInArrow(_first_links(limit), "a long, b long").distinct()
    stars = cut_lineage(connected_components(cut_lineage(_verified(first, nodes, most))))
    rooted = nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = cut_lineage(in_buckets(rooted, block_count(bits, similarity)).mapInArrow(_near_in_buckets(limit), "bucket long, a long, b long"))
    links = stars.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    links = links.unionByName(_verified(found.where("b is not null").select("a", "b").distinct(), nodes, most))
    dense = found.where("b is null").select("bucket", F.col("a").alias("node"))
    large = None
    if not dense.isEmpty():
        members = cut_lineage(_dealt(dense, nodes, part))
        parts = members.select("bucket", "part", "node", "fp").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        links = links.unionByName(parts.mapInArrow(_forests(most), "a long, b long")).distinct()
        large = members.where("parts > 1")
    links = cut_lineage(links)
    known = connected_components(links)
    if large is not None and not large.isEmpty():
        known = connected_components(cut_lineage(links.unionByName(_links_across_parts(large, cut_lineage(known), most))))
    groups = cut_lineage(known.join(nodes.select("node", "smallest"), "node"))
    roots = groups.groupBy("root").agg(F.min("smallest").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = attach(groups.select("node", "root"), roots, "root", groups.count()).select("node", "least", F.lit(True).alias("is_linked"))
    named = nodes.join(linked, "node", "left").select("node", F.when(F.col("is_linked"), F.col("least")).otherwise(F.col("smallest")).alias("component_id"), "n")
    return attach(printed.select("doc_id", "node"), named, "node", total).select("doc_id", "component_id")


def first_of_each_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, that with the smallest id (see ``first_of_groups``); all columns are kept."""
    return first_of_groups(docs, lambda texts: similar_groups(texts, shingle, similarity))
