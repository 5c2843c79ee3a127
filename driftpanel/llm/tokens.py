"""Token counts with a public tokenizer, batched by bytes, long texts split at safe boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MODEL = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of text per call of the tokenizer.
BATCH_BYTES = 1 << 18
#: Pieces whose counts a task remembers.
REMEMBERED = 400_000


def model_path(name: str = MODEL) -> str:
    """Where the installed public vocabularies keep a file; any other path can be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_safely(text: str) -> list[str]:
    """Pieces of a text whose token counts add up to those of the text.

    A cut stands before a space or line feed that follows something that is no white space. The
    pre-tokenizer of byte-level BPE starts a new unit there in any case (only it takes a leading
    space, and it never joins white space to what is before), and no special string has a space
    inside. A long run without such a place stays whole.
    """
    import re

    return re.split(r"(?<=\S)(?=[ \n])", text) if text else []


def count_tokens(texts: list[str], encode, known: dict[str, int], batch_bytes: int = BATCH_BYTES, remembered: int = REMEMBERED) -> list[int]:
    """Tokens of each text; ``encode`` maps a list of pieces to token counts, ``known`` remembers pieces."""
    pieces = [split_safely(t) for t in texts]
    if len(known) > remembered:
        known.clear()
    missing = list({p for ps in pieces for p in ps if p not in known})
    at = 0
    while at < len(missing):
        end, size = at, 0
        while end < len(missing) and size < batch_bytes:
            size += len(missing[end].encode("utf-8", "surrogatepass"))
            end += 1
        known.update(zip(missing[at:end], encode(missing[at:end]), strict=True))
        at = end
    return [sum(map(known.__getitem__, ps)) for ps in pieces]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id, text``; the rest is ignored).

    Token counts are the tokenizer's for the whole text: no begin, end or padding tokens, nothing
    cut off, special strings in a text read as the library does by default. Null and empty texts
    have 0 bytes and 0 tokens. Only counts leave the Arrow function. Texts are taken in groups of
    bounded bytes and split into pieces; each distinct piece is encoded once while it is remembered.
    """
    where = path or model_path()

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(where)
        encode = lambda batch: [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
        known: dict[str, int] = {}
        for batch in batches:
            texts, n_bytes, counts = batch.column(1), [], []
            at = 0
            while at < len(texts):
                group, size = [], 0
                while at < len(texts) and size < 4 * batch_bytes:
                    text = texts[at].as_py() or ""
                    n_bytes.append(len(text.encode("utf-8")))
                    size += n_bytes[-1]
                    group.append(text)
                    at += 1
                counts += count_tokens(group, encode, known, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
