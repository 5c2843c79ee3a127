"""Language identification: unigram pieces of a public vocabulary, summed over all segmentations."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from driftpanel.llm.tables import cut_lineage, hash60
from driftpanel.llm.tokens import model_path

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: Longest vocabulary piece in letters, the word-start mark included.
PIECE = 8
#: Longer runs of letters are scored in consecutive parts of this many letters.
RUN = 28
#: Least probability of a piece, also that of a letter outside the vocabulary.
FLOOR = 1e-8
#: Bound on the labelled documents per language that the model is fitted on.
FIT_DOCUMENTS = 4000
ROUNDS = 3
#: Distinct words that a task remembers.
REMEMBERED = 400_000
BASE = 0x9E3779B97F4A7C15
_ALMOST_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class PieceTable:
    """Pieces by polynomial hash of their code points; row ``len(pieces)`` is an unknown letter, the next one nothing."""

    pieces: list[str]
    hashes: object = field(default=None, repr=False)
    rows: object = field(default=None, repr=False)

    def __post_init__(self):
        import numpy as np

        values = np.zeros(len(self.pieces), np.uint64)
        for i, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            values[i] = h
        order = np.argsort(values)
        self.hashes, self.rows = values[order], order.astype(np.int32)

    @classmethod
    def of(cls, path: str) -> PieceTable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        return cls(sorted(p for p in known if p == "▁" or (len(p) <= PIECE and p.removeprefix("▁").isalpha() and p == p.lower())))

    def spans(self, words: list[str]):
        """Piece rows of all substrings of equally long words: array (word, start, length - 1)."""
        import numpy as np

        n = len(words[0])
        codes = np.array([list(map(ord, w)) for w in words], np.uint64).reshape(len(words), n)
        out = np.full((len(words), n, min(PIECE, n)), len(self.pieces) + 1, np.int32)
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for k in range(min(PIECE, n - i)):
                h = h * np.uint64(BASE) + codes[:, i + k] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                out[:, i, k] = np.where(self.hashes[at] == h, self.rows[at], len(self.pieces) + (k > 0))
        return out


def parts_of(word: str) -> list[str]:
    """What is scored for one lower-case word: its letters, the start marked, long ones in parts."""
    letters = "".join(filter(str.isalpha, word))
    return [("▁" if at == 0 else "") + letters[at : at + RUN] for at in range(0, len(letters), RUN)]


def forward(spans, probs):
    """Sums over segmentations of the prefixes: array (position, word, language)."""
    import numpy as np

    words, n, longest = spans.shape
    alpha = np.zeros((n + 1, words, probs.shape[1]))
    alpha[0] = 1.0
    for end in range(1, n + 1):
        for k in range(min(longest, end)):
            alpha[end] += alpha[end - k - 1] * probs[spans[:, end - k - 1, k]]
    return alpha


def log_words(words: list[str], table: PieceTable, probs):
    """Log probability of each word under each language."""
    import numpy as np

    out = np.zeros((len(words), probs.shape[1]))
    by_length: dict[int, list[tuple[int, str]]] = {}
    for i, w in enumerate(words):
        for part in parts_of(w):
            by_length.setdefault(len(part), []).append((i, part))
    for members in by_length.values():
        for at in range(0, len(members), 20_000):
            some = members[at : at + 20_000]
            last = forward(table.spans([m[1] for m in some]), probs)[-1]
            np.add.at(out, [m[0] for m in some], np.log(last))
    return out


def expected_counts(words: list[str], weights, table: PieceTable, probs):
    """Expected uses of every piece in weighted words (word, language), over all segmentations."""
    import numpy as np

    counts = np.zeros(probs.shape)
    by_length: dict[int, list[tuple[int, str]]] = {}
    for i, w in enumerate(words):
        for part in parts_of(w):
            by_length.setdefault(len(part), []).append((i, part))
    for n, members in by_length.items():
        for at in range(0, len(members), 20_000):
            some = members[at : at + 20_000]
            spans, weight = table.spans([m[1] for m in some]), weights[[m[0] for m in some]]
            alpha = forward(spans, probs)
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            for start in range(n - 1, -1, -1):
                for k in range(min(spans.shape[2], n - start)):
                    row = spans[:, start, k]
                    through = probs[row] * beta[start + k + 1]
                    beta[start] += through
                    use = weight * alpha[start] * through / alpha[n]
                    for lang in np.flatnonzero(weight.any(axis=0)):
                        counts[:, lang] += np.bincount(row, use[:, lang], len(counts))
    return counts


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probs: object = field(repr=False)


def _picked(docs: DataFrame, fit_documents: int) -> DataFrame:
    """``lang, text`` of labelled documents, at most about ``fit_documents`` per language, by the hash of the id."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and lang is not null and text is not null"
    )
    counts = labelled.groupBy("lang").count().collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, fit_documents / row["count"]))).otherwise(share)
    return labelled.where(hash60(F.lit("language"), F.col("doc_id")) <= share * float(1 << 60)).select("lang", "text")


def fit(docs: DataFrame, path: str | None = None, fit_documents: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities per language by expectation maximisation over all segmentations.

    ``docs`` holds the documents to learn from (``doc_id, text, lang``); a bounded sample per
    language is turned into word counts, which Spark tasks turn into expected piece counts. The
    driver holds one number per piece and language. Rows with a null in any of the three columns
    teach nothing; without any other row the model has no language.
    """
    import numpy as np

    table = PieceTable.of(path or model_path(VOCABULARY))
    words = (
        _picked(docs, fit_documents)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word")
        .count()
    )
    words = cut_lineage(words)
    languages = tuple(r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect())
    size = len(table.pieces)
    probs = np.full((size + 2, max(len(languages), 1)), 1.0 / size)
    probs[size], probs[size + 1] = FLOOR, 0.0
    if not languages:
        return LanguageModel((), tuple(table.pieces), probs)
    for _ in range(rounds):
        counts = np.zeros_like(probs)
        for row in _expected(words, languages, table.pieces, probs).collect():
            counts[row["piece"]] = row["total"]
        smooth = counts[:size] + 0.01
        probs = np.vstack([np.maximum(smooth / smooth.sum(axis=0), FLOOR), np.full(len(languages), FLOOR), np.zeros(len(languages))])
    return LanguageModel(languages, tuple(table.pieces), probs)


def _expected(words: DataFrame, languages: tuple[str, ...], pieces: list[str], probs) -> DataFrame:
    number = {x: i for i, x in enumerate(languages)}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table, total = PieceTable(pieces), np.zeros_like(probs)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            weights = np.zeros((len(texts), len(languages)))
            weights[np.arange(len(texts)), [number[x] for x in batch.column(0).to_pylist()]] = batch.column(2).to_numpy()
            total += expected_counts(texts, weights, table, probs)
        used = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(used), 5000):
            some = used[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["piece", "counts"])

    partial = words.mapInArrow(run, "piece long, counts array<double>")
    sums = [F.round(F.sum(F.col("counts")[i]), 6) for i in range(len(languages))]
    return partial.groupBy("piece").agg(F.array(*sums).alias("total"))


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters; number signs such as fractions and superscripts are none."""
    runs = _ALMOST_LETTERS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [part for w in runs for part in ("".join(c if c.isalpha() else " " for c in w)).split()]


def _kernel(model: LanguageModel):
    """Batches of (key, text), or of one struct with a field ``text``, to (key, lang_pred, score)."""
    languages, pieces, probs = model.languages, list(model.pieces), model.probs

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = PieceTable(pieces)
        number: dict[str, int] = {}
        logs = np.zeros((0, probs.shape[1]))
        for batch in batches:
            texts = batch.column(1) if batch.num_columns > 1 else batch.column(0).field("text")
            best, scores = [], []
            for at in range(0, len(batch), 2000):
                if len(number) > REMEMBERED:
                    number, logs = {}, logs[:0]
                found = [letter_runs(t.as_py().lower()) if t.is_valid and languages else [] for t in texts[at : at + 2000]]
                known = len(number)
                index = np.fromiter((number.setdefault(w, len(number)) for ws in found for w in ws), np.int64)
                fresh = list(number)[known:]
                logs = np.vstack([logs, log_words(fresh, table, probs)]) if fresh else logs
                ends = np.cumsum([len(ws) for ws in found])
                for ws, end in zip(found, ends, strict=True):
                    total = logs[index[end - len(ws) : end]].sum(axis=0) if len(ws) else np.zeros(1)
                    if not total.any():
                        best.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    odds = np.exp(total - total.max())
                    best.append(languages[int(np.argmax(odds))])
                    scores.append(float(odds.max() / odds.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    return run


def _with_language(keyed: DataFrame, model: LanguageModel) -> DataFrame:
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return keyed.mapInArrow(_kernel(model), StructType([keyed.schema[0], *made]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``; only ``text`` is looked at, all of it.

    A text's probability under a language is the product over its words (runs of letters, lower
    case) of the sum over all segmentations into pieces; ``score`` is the posterior of the best
    language with equal priors. A null text, one without a letter, or a model without languages
    gives ``und`` with score 0. Ties go to the language that comes first in code point order.
    """
    return _with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id's text is 1 modulo 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: fitted on the documents that are not held out, applied to all."""
    model = fit(docs.where(~held_out()), **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least`` posterior; other columns are untouched.

    Texts without a letter and undecided ones go. The decision depends on the text alone, so rows
    that share an id but not a text are judged one by one.
    """
    model = fit(docs.where(~held_out()), **options)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    kept = _with_language(keyed, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
