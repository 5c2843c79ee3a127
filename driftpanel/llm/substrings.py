"""Substring deduplication: Rabin-Karp hashes of every window of words, counted bucket by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from driftpanel.llm.tables import LAST_ID

WINDOW = 13
#: Text bytes per bucket of the hash space; a bucket is what one task sorts.
BUCKET_BYTES = 32 << 20
#: Windows that a map task holds before it sends them.
CHUNK_WINDOWS = 2_000_000
#: What travels between tasks: hashes of many documents to one slot, or the settled runs of one text.
PACKED = "slot int, ids binary, counts binary, hashes binary, digest long, spans binary"
PACKED_NAMES = ["slot", "ids", "counts", "hashes", "digest", "spans"]
#: Two odd bases of the rolling polynomials, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(words: list[bytes], window: int):
    """Two independent 64-bit polynomial hashes of every run of ``window`` words."""
    import numpy as np
    import xxhash

    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    y = (x ^ (x >> np.uint64(29))) * np.uint64(BASES[0])
    h, g = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(BASES[0]) + x[j : j + n]
        g = g * np.uint64(BASES[1]) + y[j : j + n]
    return h, g ^ (g >> np.uint64(31))


def _runs(flags):
    """Start and end of the runs of true values."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _as_bytes(x) -> bytes:
    return x.tobytes()


def _packs(slot, ids, hashes):
    """Rows of ``PACKED`` for entries sorted by (slot, id): one per slot, each id once with its number of hashes."""
    import numpy as np

    if len(slot) == 0:
        return
    edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    for a, b in zip(edge, np.r_[edge[1:], len(slot)], strict=True):
        mine = ids[a:b]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        counts = np.diff(np.r_[first, len(mine)]).astype(np.int32)
        yield int(slot[a]), _as_bytes(mine[first]), _as_bytes(counts), _as_bytes(hashes[a:b]), None, None


def _batches(rows, size: int = 512):
    import pyarrow as pa

    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    for at in range(0, len(rows), size):
        columns = zip(*rows[at : at + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], PACKED_NAMES)


def _ship(window: int, buckets: int, chunk_windows: int):
    """Map side: the distinct windows of a chunk go to their buckets, with the smallest id that has them here.

    Windows that a smaller id of the same chunk has too are settled on the spot, as runs of window
    positions of this very text. So a window that very many documents share costs one entry a chunk.
    """

    def flush(parts):
        import numpy as np

        parts.sort(key=lambda p: p[0])
        ids = np.array([p[0] for p in parts], np.int64)
        digests = [p[1] for p in parts]
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        offsets = np.r_[0, np.cumsum(sizes)]
        h = np.concatenate([p[2] for p in parts])
        slot = np.concatenate([p[3] for p in parts])
        parts.clear()
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        head = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
        least = ids[doc[order[head]]][np.cumsum(head) - 1]
        late = np.zeros(len(h), bool)
        late[order] = ids[doc[order]] > least
        sent = order[head]
        del order, sorted_h, head, least
        sent = sent[np.lexsort((doc[sent], slot[sent]))]
        rows = list(_packs(slot[sent], ids[doc[sent]], h[sent]))
        for d in np.unique(doc[late]):
            starts, ends = _runs(late[offsets[d] : offsets[d + 1]])
            spans = np.column_stack([starts, ends]).astype(np.int32)
            rows.append((int(d % buckets), _as_bytes(ids[d : d + 1]), None, None, digests[d], _as_bytes(spans)))
        yield from _batches(rows)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, t in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
                text = t.as_py() or b""
                h, g = window_hashes(text.split(), window)
                if len(h) == 0:
                    continue
                parts.append((LAST_ID if i is None else i, np.int64(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64)), h, (g % np.uint64(buckets)).astype(np.int32)))
                held += len(h)
                if held >= chunk_windows:
                    yield from flush(parts)
                    held = 0
        if parts:
            yield from flush(parts)

    return run


def _unpacked(batches, passed: list):
    """Document ids and hashes of packed rows, flat; rows of settled runs are appended to ``passed``."""
    import numpy as np

    ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        for i, c, h, digest, spans in zip(*[batch.column(n).to_pylist() for n in PACKED_NAMES[1:]], strict=True):
            if h is None:
                passed.append((int(np.frombuffer(i, np.int64)[0]), digest, spans))
            else:
                ids.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)))
                hashes.append(np.frombuffer(h, np.uint64))
    return np.concatenate(ids), np.concatenate(hashes)


def _slots(ids, slots: int):
    import numpy as np

    mixed = ids.astype(np.uint64) * np.uint64(BASES[0])
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(slots)).astype(np.int32)


def _settle(slots: int):
    """Reduce side: one bucket of the hash space; sends the hashes that a smaller id has too on to their documents' slots."""

    def run(batches):
        import numpy as np

        passed: list = []
        doc, h = _unpacked(batches, passed)
        rows = [(int(_slots(np.array([i]), slots)[0]), np.int64(i).tobytes(), None, None, digest, spans) for i, digest, spans in passed]
        if len(h):
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            late = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.r_[head, len(h)]))
            h, doc = h[late], doc[late]
            slot = _slots(doc, slots)
            order = np.lexsort((doc, slot))
            rows += _packs(slot[order], doc[order], h[order])
        yield from _batches(rows)

    return run


def _gather(batches):
    """One slot of documents: a row for each that has settled windows."""
    import numpy as np
    import pyarrow as pa

    passed: list = []
    doc, h = _unpacked(batches, passed)
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], h[order]
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    found: dict[int, list] = {}
    for a, b in zip(edge, np.r_[edge[1:], len(doc)] if len(doc) else edge, strict=True):
        found[int(doc[a])] = [{"digest": None, "spans": None, "hashes": h[a:b].tobytes()}]
    for i, digest, spans in passed:
        found.setdefault(i, []).append({"digest": digest, "spans": spans, "hashes": None})
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("spans", pa.binary()), ("hashes", pa.binary())]))
    for at in range(0, len(found), 2048):
        some = list(found.items())[at : at + 2048]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([x for _, x in some], kind)], ["doc_id", "found"])


def _trim(window: int, layout: bool):
    """Per document: the words outside all windows that are settled as repeated, and the removed intervals."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n_words, n_removed, intervals, kept_text = [], [], [], []
            for t, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text = t.as_py() or b""
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if found.is_valid and len(words) >= window:
                    h, _ = window_hashes(words, window)
                    hit = np.zeros(len(h), bool)
                    digest, sets = None, []
                    for x in found.as_py():
                        if x["hashes"] is not None:
                            sets.append(np.frombuffer(x["hashes"], np.uint64))
                            continue
                        if digest is None:
                            digest = int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))
                        if x["digest"] == digest:
                            for a, b in np.frombuffer(x["spans"], np.int32).reshape(-1, 2):
                                hit[a:b] = True
                    if sets:
                        hit |= np.isin(h, np.concatenate(sets))
                    starts, ends = _runs(hit)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, ends + window - 1, -1)
                covered = np.cumsum(gone[:-1]) > 0
                starts, ends = _runs(covered)
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                intervals.append([{"first": int(a), "after": int(b)} for a, b in zip(starts, ends, strict=True)])
                if len(starts):
                    words = [w for w, x in zip(words, covered, strict=True) if not x]
                kept_text.append(t.as_py() if layout and not len(starts) else b" ".join(words))
            spans = pa.array(intervals, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), spans, pa.array(kept_text, pa.binary()).cast(pa.string())],
                ["row", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """``doc_id, found``: per document with any, its windows that also start in a document with a smaller id.

    ``found`` lists hashes of windows, or runs of window positions for the text of the given digest.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes), 1)
    sent = texts.mapInArrow(_ship(window, buckets, chunk_windows), PACKED)
    settled = sent.repartitionById(buckets, F.col("slot")).mapInArrow(_settle(buckets), PACKED)
    return settled.repartitionById(buckets, F.col("slot")).mapInArrow(_gather, "doc_id long, found array<struct<digest:long,spans:binary,hashes:binary>>")


def trimmed(docs: DataFrame, window: int = WINDOW, layout: bool = False, **limits) -> DataFrame:
    """``row, n_words, n_removed, removed, kept`` of every row: what is left without repeated windows.

    A word goes when a window of ``window`` consecutive words covers it whose sequence also starts
    in a document with a smaller id, judged on the input; overlapping windows merge into maximal
    intervals ``removed`` (first word, word after the last). ``kept`` holds the kept words joined by
    one space; with ``layout`` a text that loses nothing stays byte for byte (null stays null).
    Null and empty texts have no words; texts shorter than the window lose nothing; repetition
    within one document removes nothing from that document; rows that share an id never remove
    from each other; a null id counts as the largest. The other columns of ``docs`` pass through in
    the struct ``row``, so no name can clash. An empty table gives an empty result.

    Two documents' windows are taken as equal when two polynomial hashes agree, 64 bits and the
    bucket number, so the odds of a false match fall with more buckets: about 1e-7 a bucket.
    """
    found = repeated_windows(docs, window, **limits).select(F.col("doc_id").alias("__llm_id"), F.col("found").alias("__llm_found"))
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    key = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID))
    joined = packed.join(found, key == F.col("__llm_id"), "left").select("row", "text", F.col("__llm_found").alias("found"))
    made = StructType.fromDDL("n_words long, n_removed long, removed array<struct<first:int,after:int>>, kept string")
    return joined.mapInArrow(_trim(window, layout), StructType([joined.schema["row"], *made.fields]))


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, ``n_chars`` (if there) recounted, and emptied documents gone.

    A text that loses nothing stays as it is, byte for byte; so do null texts.
    """
    types = dict(docs.dtypes)
    cut = trimmed(docs, window, layout=True).where("n_words = 0 or n_removed < n_words")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"}
    out["text"] = F.col("kept").cast(types["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(types["n_chars"])).otherwise(out["n_chars"])
    return cut.select(*[out[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: the texts that are left as digests."""
    return trimmed(docs.select("doc_id", "text"), window).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
