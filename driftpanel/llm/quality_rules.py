"""Quality rules as a learned decision list: sequential covering over statistics of labelled texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.llm.tables import hash60

REPEAT_WINDOW = 8
#: Bound on the labelled rows that a list is learned from (picked by smallest hash of the id).
FIT_ROWS = 40_000
SYMBOLS = "#*$%&|<>"
#: Counts of the contract, then ratios that the learner may test.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "punct_share", "distinct_share", "same_next_share", "bar_share")
FEATURES = ("n_words", *RATIOS)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``window`` words whose sequence is found twice or more in the text."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Exact ranks of windows by doubling: the rank of 2k words is the rank of a pair of ranks of k words.
    rank, length = x, 1
    while length < window:
        step = min(length, window - length)
        a, b = rank[: len(rank) - step], rank[step:]
        rank = np.unique(a * (int(rank.max()) + 1) + b, return_inverse=True)[1].reshape(-1)
        length += step
    twice = np.bincount(rank)[rank] > 1
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + window, -1)
    return int((np.cumsum(gone[:-1]) > 0).sum())


def statistics_of(text: str) -> tuple:
    """``COUNTS`` and ``RATIOS`` of one whole text."""
    words = text.encode("utf-8").split()
    n = len(words)
    if n == 0:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    chars = len(b"".join(words).decode("utf-8"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    filled = duplicates = 0
    for line in text.split("\n"):
        if line.encode("utf-8").split():
            filled += 1
            duplicates += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    upper = sum(map(str.isupper, text))
    punct = sum(map(text.count, ".,;:!?"))
    same_next = sum(map(bytes.__eq__, words[1:], words[:-1]))
    ratios = (
        chars / n,
        symbols / chars,
        duplicates / filled,
        repeats / n,
        upper / chars,
        punct / chars,
        len(set(words)) / n,
        same_next / n,
        text.count("|") / n,
    )
    return (n, chars, symbols, duplicates, repeats, *(round(r, 6) for r in ratios))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``COUNTS`` (long) and ``RATIOS`` (double) of every row; null and empty texts are all zero."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [statistics_of(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * (len(COUNTS) + len(RATIOS))
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *COUNTS, *RATIOS]
            )

    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in RATIOS]])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (feature, "<=" or ">", threshold) hold: the row is rejected."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:g}" for f, op, t in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for feature, op, threshold in self.tests:
            out = out & ((F.col(feature) <= threshold) if op == "<=" else (F.col(feature) > threshold))
        return out


def _holds(tests, x):
    import numpy as np

    out = np.ones(len(next(iter(x.values()))), bool)
    for f, op, t in tests:
        out &= (x[f] <= t) if op == "<=" else (x[f] > t)
    return out


def _grow(x, y, thresholds, most_tests: int):
    """Adds the test with the largest information gain until only rejected rows are covered."""
    import numpy as np

    tests: list = []
    inside = np.ones(len(y), bool)
    while len(tests) < most_tests:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if n == 0 or p == 0:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for f, cuts in thresholds.items():
            values, good = x[f][inside], y[inside]
            low_p = np.searchsorted(np.sort(values[good]), cuts, side="right")
            low_n = np.searchsorted(np.sort(values[~good]), cuts, side="right")
            for op, ps, ns in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, op, float(cuts[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _holds([best[1]], x)
    return tests


def _worth(tests, x, y) -> float:
    inside = _holds(tests, x)
    p, n = int(y[inside].sum()), int((~y[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_list(x: dict, rejected, most_rules: int = 24, most_tests: int = 4, precision: float = 0.9, least: int = 8, cuts: int = 64) -> list[Rule]:
    """Ordered rules from arrays of statistics ``x`` and a boolean array ``rejected``.

    Sequential covering: of the rows not covered yet, two thirds grow a conjunction test by test,
    one third prunes its last tests while that does not lower (p - n) / (p + n). A rule must reject
    at least ``least`` rows with ``precision`` on all rows left; the first that fails ends the list.
    """
    import numpy as np

    y = np.asarray(rejected, bool)
    x = {f: np.asarray(v, float) for f, v in x.items()}
    turn = np.arange(len(y)) % 3
    left, rules = np.ones(len(y), bool), []
    thresholds = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))) for f, v in x.items()} if len(y) else {}
    thresholds |= {f: np.unique(np.r_[t, np.quantile(x[f][y], np.linspace(0, 1, cuts + 1))]) for f, t in thresholds.items() if y.any()}
    while len(rules) < most_rules and y[left].any():
        grow, prune = left & (turn != 2), left & (turn == 2)
        tests = _grow({f: v[grow] for f, v in x.items()}, y[grow], thresholds, most_tests)
        held = {f: v[prune] for f, v in x.items()}
        while len(tests) > 1 and _worth(tests[:-1], held, y[prune]) >= _worth(tests, held, y[prune]):
            tests = tests[:-1]
        inside = left & _holds(tests, x)
        p, n = int(y[inside].sum()), int(inside.sum())
        if not tests or p < least or p / n < precision:
            break
        rules.append(Rule(tuple(tests), p / n, n))
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over ``FEATURES``: the number of the first rule that holds, else null."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> list[Rule]:
    """A decision list from ``labels`` (``doc_id, quality``; 0 is rejected) and the texts that have them.

    The sample is bounded: ids are kept below a hash threshold that lets ``fit_rows`` labels pass on
    average, so it is the same in every run. Labels without a document, with null or with
    contradicting quality are left out; without any rejected label the list is empty.
    """
    import numpy as np

    clean = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").alias("quality"))
    )
    n = clean.count()
    share = min(1.0, fit_rows / max(n, 1))
    picked = clean.where(hash60(F.lit("rules"), F.col("doc_id")) <= int(share * (1 << 60)))
    # About fit_rows ids pass the threshold, whatever the tables hold: they go to the texts, not the texts to them.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # The kernel returns statistics by id; the label is joined again, both sides are bounded by the sample.
    table = text_statistics(texts).distinct().join(picked, "doc_id").select("doc_id", "quality", *FEATURES).toPandas()
    table = table.drop_duplicates("doc_id").sort_values("doc_id")
    return learn_list({f: table[f].to_numpy(float) for f in FEATURES}, (table["quality"].to_numpy() == 0), **options) if len(table) else []


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``rule`` (number of the rule that rejects, else null), and ``kept`` of every row.

    A null or empty text has no words and fails the base; every row returns one row.
    """
    stats = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )
