"""Token ids of a corpus as ORC files in document order: integer run lengths, row indexes, Bloom filters, stripe-parallel reads."""

from __future__ import annotations

import itertools
import json
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftpanel.functions.lineage import shared_folder
from driftpanel.llm.tables import text_key
from driftpanel.llm.tokens import model_path

MODEL = "word_bpe_49k.json"
#: Id that ends every document.
END_ID = 2
#: Text bytes per file; a file is what one task sorts, encodes and writes.
FILE_BYTES = 32 << 20
#: Bytes of text that are encoded together, and words that a Python worker remembers.
GROUP_BYTES = 1 << 20
REMEMBERED = 350_000
#: Words per line that goes to the library, and the control character that stands between them.
LINE = 64
MARK = "\x02"
#: Letters of ASCII and of Latin-1 from U+00C0, all composed; each lower-cases by itself to a letter of it. No other
#: character there has the second byte of a letter, so in valid UTF-8 the letters' bytes make up letters only.
LETTERS = "".join(c for c in map(chr, [*range(128), *range(0xC0, 0x100)]) if c.isalpha())
#: Signs of ASCII that never join letters before them; an apostrophe does (``'s``).
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Normalizer and pre-tokenizer that leave a lower-case word of letters as it is and whole.
LETTER_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
ROW_COLUMNS = "part int, doc_id long, first long, n int, ids array<int>"
#: Writer options: stripes are what one reader task takes at least (their size is looked at every 200 rows),
#: each 10,000 rows have an entry of the row index.
ORC = {
    "orc.stripe.size": str(16 << 20),
    "orc.rows.between.memory.checks": "200",
    "orc.row.index.stride": "10000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}


class WordIds:
    """Token ids of byte texts through a table of the words seen so far.

    Words are what ASCII white space separates. ``encode`` (a list of strings to an iterable of id
    lists) must treat such words one by one: the vocabulary's normalizer and pre-tokenizer drop
    white space and look at nothing beyond it, and no special string contains any. New words go to
    the library ``LINE`` at a time, with a mark between them whose one id no other word here has.
    With ``letters`` (see ``letter_encoder``), words of ``LETTERS`` go there without a mark, the ids in ``last`` end them,
    and words that such letters begin and ``SIGNS`` end are looked up as two. A full table keeps the words that were met again.
    """

    def __init__(self, encode, remembered: int = REMEMBERED, letters=None):
        import numpy as np

        self.encode, self.remembered = encode, remembered
        self.letters, self.last = letters or (None, None)
        marks = next(iter(encode([MARK])))
        self.mark = marks[0] if len(marks) == 1 else None
        self.index = defaultdict(itertools.count().__next__)
        self.start, self.length, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words met twice or more, half a table at most, the most used first."""
        import numpy as np

        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.remembered // 2:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.remembered // 2])
        words = list(self.index)
        self.index = defaultdict(itertools.count(len(kept)).__next__, {words[k]: i for i, k in enumerate(kept.tolist())})
        self.flat = _gathered(self.flat, self.start[kept], self.length[kept])
        self.length = self.length[kept]
        self.start = np.cumsum(self.length) - self.length
        self.uses = np.zeros(len(kept), np.int64)

    def _encoded(self, words, valid: bool):
        """Ids of all words in a row, and the number of each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = np.zeros(len(words), np.int8)
        length = np.zeros(len(words), np.int64)
        found = {}
        if valid and self.letters is not None:
            plain = pc.and_(pc.equal(pc.binary_length(pc.ascii_ltrim(words, LETTERS)), 0), pc.greater(pc.binary_length(words), 0))
            kind[plain.to_numpy(zero_copy_only=False)] = 2
        if (kind == 2).any():
            latin = words.filter(pa.array(kind == 2))
            lines = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(0, len(latin), LINE), len(latin)].astype(np.int32)), latin)
            lines = [line.lower() for line in pc.binary_join(lines, " ").to_pylist()]
            found[2] = np.fromiter(itertools.chain.from_iterable(self.letters(lines)), np.int32)
            length[kind == 2] = np.diff(np.r_[-1, np.flatnonzero(self.last[found[2]])])
        rest = [w.decode("utf-8", "replace") for w in _bytes(words.filter(pa.array(kind == 0)))]
        kind[kind == 0] = [self.mark is None or MARK in t for t in rest]
        joined = [t for t in rest if self.mark is not None and MARK not in t]
        lines = [f" {MARK} ".join(joined[i : i + LINE]) + f" {MARK}" for i in range(0, len(joined), LINE)]
        ids = np.fromiter(itertools.chain.from_iterable(self.encode(lines)), np.int32)
        ends = np.flatnonzero(ids == self.mark) if len(ids) else np.zeros(0, np.int64)
        length[kind == 0] = np.diff(np.r_[-1, ends]) - 1
        found[0] = ids[ids != self.mark] if len(ids) else ids
        parts = list(self.encode([t for t in rest if self.mark is None or MARK in t]))
        length[kind == 1] = [len(p) for p in parts]
        found[1] = list(itertools.chain.from_iterable(parts))
        order = np.repeat(kind, length)
        flat = np.empty(len(order), np.int32)
        for k, own in found.items():
            flat[order == k] = own
        return flat, length

    def _parts(self, words, valid: bool):
        """A row of words, or two of equal length: letters, ASCII ones in lower case, and the signs behind them. Words of another form stand in the first.

        The vocabulary's normalizer lower-cases letter by letter, and its pre-tokenizer ends a unit where
        letters end, so the ids are those of the parts one after the other.
        """
        import pyarrow.compute as pc

        if not valid or self.letters is None:
            return [words]
        head, tail = pc.ascii_rtrim(words, SIGNS), pc.ascii_ltrim(words, LETTERS)
        whole = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(words))
        return [pc.if_else(whole, pc.ascii_lower(head), words), pc.if_else(whole, tail, "")]

    def _numbers(self, words, valid: bool):
        """The table's numbers of distinct words; new ones are encoded."""
        import numpy as np

        known = len(self.length)
        numbers = np.fromiter(map(self.index.__getitem__, _bytes(words)), np.int64, len(words))
        if len(self.index) > known:
            flat, length = self._encoded(words.filter(numbers >= known), valid)
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(length) - length]
            self.length, self.flat = np.r_[self.length, length], np.r_[self.flat, flat]
            self.uses = np.r_[self.uses, np.zeros(len(length), np.int64)]
        return numbers

    def __call__(self, texts, end_id: int | None = None):
        """Ids of all texts (a list of bytes or an Arrow array of strings without nulls) in a row, and the number of each text; ``end_id`` follows every text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.length) > self.remembered:
            self._forget()
        if isinstance(texts, list):
            texts = pa.array(texts, pa.binary()).view(pa.string())
        try:
            texts.validate(full=True)
            valid = True
        except pa.ArrowInvalid:
            valid = False
        # text by text to words, distinct words, parts, distinct parts
        lists = pc.ascii_split_whitespace(texts)
        n_words = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        parts = self._parts(words.dictionary, valid)
        keys = pa.concat_arrays(parts).dictionary_encode()
        pairs = self._numbers(keys.dictionary, valid)[keys.indices.to_numpy()].reshape(len(parts), -1)
        often = np.bincount(at, minlength=len(words.dictionary))
        for own in pairs:
            self.uses += np.bincount(own, weights=often, minlength=len(self.uses)).astype(np.int64)
        # back to words and to texts
        pairs = pairs.T.ravel()
        flat = _gathered(self.flat, self.start[pairs], self.length[pairs])
        length = self.length[pairs].reshape(-1, len(parts)).sum(1)
        start = np.cumsum(length) - length
        if end_id is not None:
            end = len(length)
            start, length, flat = np.r_[start, len(flat)], np.r_[length, 1], np.r_[flat, np.int32(end_id)]
            at = np.insert(at, np.cumsum(n_words), end)
            n_words = n_words + 1
        sizes = length[at]
        total = np.r_[0, np.cumsum(sizes)][np.cumsum(n_words)] if len(n_words) else np.zeros(0, np.int64)
        return _gathered(flat, start[at], sizes), np.diff(np.r_[0, total])


def _gathered(flat, start, length):
    """Runs of ``flat`` one after the other."""
    import numpy as np

    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


def _bytes(words) -> list[bytes]:
    import pyarrow as pa

    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def letter_encoder(tokenizer):
    """The tokenizer's model for lower-case words of Latin letters: lines to id lists, and which ids end a word; None if it does not fit.

    Where the pre-tokenizer keeps runs of letters whole and the normalizer composes and lower-cases, such a word is one unit and
    unchanged, so a split at spaces gives the model the same units. The model's suffix tells which ids end a unit.
    """
    import numpy as np
    from tokenizers import Tokenizer, pre_tokenizers

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix or tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return None
    rules = [json.loads(tokenizer.normalizer.__getstate__()), json.loads(tokenizer.pre_tokenizer.__getstate__())]
    if rules != LETTER_RULES:
        return None
    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for unit, i in vocabulary.items() if unit.endswith(suffix)]] = True
    return (lambda texts: (e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False))), last


_TABLES: dict[str, WordIds] = {}


def word_ids_of(where: str) -> WordIds:
    """The word table of a vocabulary file; tasks that one Python worker runs share it, which changes no result."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if where not in _TABLES:
        tokenizer = Tokenizer.from_file(where)
        encode = lambda texts: (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        _TABLES[where] = WordIds(encode, letters=letter_encoder(tokenizer))
    return _TABLES[where]


def _encoder(where: str, end_id: int, group_bytes: int):
    """Sorted ``doc_id, text`` rows of one file to its rows; ``first`` is the number of ids before the row in the file."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        word_ids = word_ids_of(where)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            at = 0
            while at < len(texts):
                stop = int(np.searchsorted(ends, group_bytes + (ends[at - 1] if at else 0))) + 1
                ids, n = word_ids(texts.slice(at, stop - at), end_id)
                offsets = np.r_[0, np.cumsum(n)]
                columns = [
                    pa.array(np.full(len(n), part, np.int32)),
                    batch.column(0).slice(at, len(n)),
                    pa.array(before + offsets[:-1]),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "first", "n", "ids"])
                before += int(offsets[-1])
                at += len(n)

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES, options: dict | None = None) -> None:
    """Write the ids of every whole text of ``docs`` (``doc_id, text``; other columns are ignored) as ORC under ``path``.

    Rows are ``part, doc_id, first, n, ids``: documents in ascending id order within and across
    files (``part`` numbers them), ``first`` counts the ids before a document in its file. Null and
    empty texts hold the end id alone. Null ids come last; documents that share an id (or have
    none) follow in order of a text key, and they are cut into files like any others. Only rows with
    equal id and text are in no stated order; they are equal. A table without rows gives no rows.
    """
    where = vocabulary or model_path(MODEL)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    keyed = rows.withColumns({"key": text_key(), "row": F.monotonically_increasing_id()})
    order: list[Column] = [F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("row")]
    ordered = keyed.repartitionByRange(size // file_bytes + 1, *order).sortWithinPartitions(*order)
    encoded = ordered.select("doc_id", "text").mapInArrow(_encoder(where, end_id, GROUP_BYTES), ROW_COLUMNS)
    encoded.write.options(**(ORC | (options or {}))).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_ids`` wrote; tasks take ranges of stripes, and filters on ``doc_id`` skip stripes and row groups."""
    return spark.read.schema(ROW_COLUMNS).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of the given documents: file and stripe ranges, the row index and the Bloom filters leave out the rest."""
    return read_ids(spark, path).where(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "ids")


def positions(stored: DataFrame) -> DataFrame:
    """``part, base``: ids in all files before a file. Only the short columns are read; blocks of 1,024 files are added up first."""
    totals = stored.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("size")).withColumn("block", F.expr("part div 1024"))
    blocks = totals.groupBy("block").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("start"))
    before = totals.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return before.join(starts, "block").select("part", (F.col("start") + F.col("before")).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    ``start`` counts the ids of all documents before it; the checksum is that of the document's ids
    as little-endian unsigned 32-bit integers.
    """
    stored = read_ids(spark, path)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy().astype("<u4", copy=False)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(flat[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "first", "n_tokens", "ids_crc32"])

    read = stored.select("part", "doc_id", "first", "ids").mapInArrow(run, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    placed = read.join(positions(stored), "part")
    return placed.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def store_digests(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to a new folder of the shared folder and return the digests that are read back from it."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/driftpanel-ids-{uuid.uuid4().hex}"
    write_ids(docs, path)
    return digests(spark, path)
