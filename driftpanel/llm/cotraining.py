"""Quality scores by co-training a classifier of the text with one of the page's metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from driftpanel.llm.tables import hash60

#: Bounds on the labelled rows and on the unlabelled pool (picked by smallest hash of the id).
FIT_ROWS = 12_000
POOL_ROWS = 12_000
ROUNDS = 3
#: A view hands on a pseudo-label when its calibrated probability of the class reaches this.
CONFIDENT = 0.97
#: Of its confident rows, a view hands on at most this many a round, classes in the proportion of the labels.
EXCHANGED = 1000
WORD_SLOTS = 384
SHAPE_SLOTS = 128
META_SLOTS = 64
TEXT_SIZE = WORD_SLOTS + SHAPE_SLOTS + 4
META_SIZE = META_SLOTS + 8


def _slot(data: bytes, slots: int, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed) % slots


def word_slots(word: bytes) -> tuple[int, int]:
    """Feature numbers of a word: of its lower-case form, and of its shape (runs of letter case, digits, other signs)."""
    text = word.decode("utf-8", "replace")
    shape: list[str] = []
    for c in text:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    return _slot(text.lower().encode("utf-8"), WORD_SLOTS, 1), WORD_SLOTS + _slot("".join(shape).encode("utf-8"), SHAPE_SLOTS, 2)


def text_view(text: str | None, slots: dict):
    """Frequencies of hashed words and word shapes, and how a text repeats itself; all zero without words."""
    import numpy as np

    words = (text or "").encode("utf-8").split()
    n = len(words)
    out = np.zeros(TEXT_SIZE, np.float32)
    if n:
        for w in set(words):
            if w not in slots:
                slots[w] = word_slots(w)
        pairs = np.array([slots[w] for w in words])
        out[: WORD_SLOTS + SHAPE_SLOTS] = np.sqrt(np.bincount(pairs.reshape(-1), minlength=WORD_SLOTS + SHAPE_SLOTS) / n)
        same = sum(map(bytes.__eq__, words[1:], words[:-1]))
        out[-4:] = same / n, len(set(words)) / n, min(n, 20) / 20, sum(map(len, words)) / n / 16
    return out


def meta_view(source, lang, n_chars, n_lines):
    """Hashed source and language, and layout sizes in logarithms."""
    import numpy as np

    out = np.zeros(META_SIZE, np.float32)
    out[_slot(b"s" + ("" if source is None else str(source)).encode(), META_SLOTS, 3)] = 1
    out[_slot(b"l" + ("" if lang is None else str(lang)).encode(), META_SLOTS, 4)] = 1
    chars, lines = max(n_chars or 0, 0), max(n_lines or 0, 0)
    size, per_line = np.log1p(chars) / 10, np.log1p(chars / (lines + 1)) / 10
    out[META_SLOTS:] = size, size**2, np.log1p(lines) / 5, per_line, per_line**2, chars == 0, source is None, lang is None
    return out


def fit_linear(x, y, weight=None, ridge: float = 1e-3, steps: int = 12):
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def raw_score(x, w):
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class QualityModel:
    """Linear weights of both views, their calibration (slope, intercept) and the log odds of the labels."""

    text: object = field(repr=False)
    meta: object = field(repr=False)
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float
    exchanged: int

    def probability(self, text_x, meta_x):
        """Calibrated views count as independent given the class: their log odds add, the prior counts once."""
        import numpy as np

        a = self.text_scale[0] * raw_score(text_x, self.text) + self.text_scale[1]
        b = self.meta_scale[0] * raw_score(meta_x, self.meta) + self.meta_scale[1]
        return 1 / (1 + np.exp(-np.clip(a + b - self.prior, -40, 40)))


def _calibrated(scores, y) -> tuple[float, float]:
    w = fit_linear(scores[:, None], y, ridge=1e-6)
    return max(float(w[0]), 0.0), float(w[1])


def co_train(text_x, meta_x, y, pool_text, pool_meta, rounds: int = ROUNDS, confident: float = CONFIDENT, exchanged: int = EXCHANGED) -> QualityModel:
    """Two linear views; each round, each labels the pool rows that it is sure of for the other.

    Every fourth labelled row is kept out of training and calibrates both views.
    """
    import numpy as np

    y = np.asarray(y, float)
    held = np.arange(len(y)) % 4 == 3
    if held.sum() < 8 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    used = held if held.any() else np.ones(len(y), bool)
    views = [(text_x, pool_text), (meta_x, pool_meta)]
    extra: list[dict[int, float]] = [{}, {}]
    share = float(np.clip(y.mean(), 0.01, 0.99))
    for turn in range(rounds + 1):
        weights, scales = [], []
        for v, (x, pool) in enumerate(views):
            rows = np.fromiter(extra[v], int, len(extra[v]))
            more = np.fromiter(extra[v].values(), float, len(extra[v]))
            w = fit_linear(np.vstack([x[~held], pool[rows]]), np.r_[y[~held], more])
            weights.append(w)
            scales.append(_calibrated(raw_score(x[used], w), y[used]))
        if turn == rounds or not len(pool_text):
            break
        for v, (_, pool) in enumerate(views):
            p = 1 / (1 + np.exp(-np.clip(scales[v][0] * raw_score(pool, weights[v]) + scales[v][1], -40, 40)))
            for label, sure, most in ((1.0, p, round(exchanged * share)), (0.0, 1 - p, round(exchanged * (1 - share)))):
                fresh = [int(i) for i in np.argsort(-sure, kind="stable") if sure[i] >= confident and int(i) not in extra[1 - v]][:most]
                extra[1 - v].update(dict.fromkeys(fresh, label))
    return QualityModel(weights[0], weights[1], scales[0], scales[1], float(np.log(share / (1 - share))), len(extra[0]) + len(extra[1]))


def _inputs(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"),
    )


def _views(batches):
    """Batches of ``_inputs`` to (batch, text features, metadata features), in blocks of bounded size."""
    import numpy as np

    slots: dict = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            if len(slots) > 400_000:
                slots.clear()
            text_x = np.array([text_view(t.as_py(), slots) for t in batch.column(1)])
            meta_x = np.array([meta_view(*row) for row in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True)])
            if batch.num_rows:
                yield batch, text_x, meta_x


def _features(docs: DataFrame):
    """Features of a bounded sample, on the driver: ids, text view, metadata view, in order of the id."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch, text_x, meta_x in _views(batches):
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (text_x, meta_x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["doc_id", "text_x", "meta_x"])

    table = _inputs(docs).mapInArrow(run, "doc_id long, text_x binary, meta_x binary").toArrow().to_pandas().drop_duplicates("doc_id").sort_values("doc_id")
    unpack = lambda column, size: np.frombuffer(b"".join(column), np.float32).reshape(len(column), size)
    return table["doc_id"].to_numpy(), unpack(table["text_x"], TEXT_SIZE), unpack(table["meta_x"], META_SIZE)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS, **options) -> QualityModel | None:
    """A model from ``labels`` (``doc_id, quality``) and a pool of documents without one; both samples are bounded by parameters.

    Labels that are null, contradict each other, or have no document are left out. None when the
    labels left are not of both classes.
    """
    import numpy as np

    clean = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").alias("quality"))
    )
    known = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    key = hash60(F.lit("quality"), F.col("doc_id"))
    picked = clean.where(key <= int(min(1.0, fit_rows / max(clean.count(), 1)) * (1 << 60)))
    ids, text_x, meta_x = _features(known.join(picked.select("doc_id"), "doc_id", "left_semi"))
    quality = {r["doc_id"]: float(r["quality"] != 0) for r in picked.collect()}
    y = np.array([quality[i] for i in ids.tolist()])
    if len(set(y)) < 2:
        return None
    share = min(1.0, 1.2 * pool_rows / max(known.count(), 1))
    _, pool_text, pool_meta = _features(known.where(key <= int(share * (1 << 60))).join(clean.select("doc_id"), "doc_id", "left_anti"))
    return co_train(text_x, meta_x, y, pool_text[:pool_rows], pool_meta[:pool_rows], **options)


def scored(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, text_score, meta_score, kept`` of every row of ``docs`` (``doc_id, text, source, lang, n_chars``).

    ``score`` is the probability of good quality from both views, the other two are those of one
    view. Nulls in any column are features of their own or zeros; a null or empty text has an
    all-zero text view. Without a model every score is 0.5 and every row is kept.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, text_x, meta_x in _views(batches):
            if model is None:
                columns = [np.full(batch.num_rows, 0.5)] * 3
            else:
                one = lambda x, w, s: 1 / (1 + np.exp(-np.clip(s[0] * raw_score(x, w) + s[1], -40, 40)))
                columns = [model.probability(text_x, meta_x), one(text_x, model.text, model.text_scale), one(meta_x, model.meta, model.meta_scale)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.float64()) for c in columns]], ["doc_id", "score", "text_score", "meta_score"])

    return (
        _inputs(docs).mapInArrow(run, "doc_id long, score double, text_score double, meta_score double").withColumn("kept", F.col("score") >= threshold)
    )
