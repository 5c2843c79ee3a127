"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask marks which words of a short span are hashed; the others may differ. Windows of test items
and of documents that agree under a mask propose an alignment (item, shift), which is then checked
word by word. The two masks (found by exhaustive search over substitution patterns) are lossless
for the tolerance below: 9 words with one substitution, 14 with two, 18 with three always keep a
window that agrees under one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.llm.tables import text_key

#: Word offsets that a seed hashes.
MASKS = ((0, 2, 3, 4, 5, 6), (0, 1, 2, 3, 6, 7))
#: An aligned run of this many words (or the whole item, if shorter) is judged.
REACH = 18
#: Items with fewer words cannot be told from chance and never match.
MIN_WORDS = 8
#: (words of the run, substitutions allowed)
TOLERANCE = ((18, 3), (14, 2), (9, 1), (8, 0))
#: Seeds of the test items are broadcast up to this many rows (about 32 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _positions(hashes: str, mask: tuple[int, ...]) -> Column:
    """How many windows of a mask an array of word hashes has."""
    return F.greatest(F.size(hashes) - mask[-1], F.lit(0))


def _seeds(hashes: str) -> Column:
    """All seeds of an array column of word hashes: those of the first mask by position, then those of the second."""

    def under(number: int, mask: tuple[int, ...]) -> Column:
        n = _positions(hashes, mask)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(number), *[F.element_at(F.col(hashes), i + o) for o in mask]))

    return F.concat(*[under(k, m) for k, m in enumerate(MASKS)])


def _seed_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, at, seed`` of every window of ``words`` (array of hashes); ``at`` is the first word's position."""
    seeded = rows.select(*keys, _positions("words", MASKS[0]).alias("firsts"), F.posexplode(_seeds("words")).alias("pos", "seed"))
    at = F.when(F.col("pos") < F.col("firsts"), F.col("pos")).otherwise(F.col("pos") - F.col("firsts"))
    return seeded.select(*keys, at.alias("at"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_items, shift, run, equal``: verified alignments of documents with test items.

    A document overlaps an item when, on one alignment, a run of ``REACH`` words (the whole item if
    it is shorter) differs in at most 3 words (2 below 18 words, 1 below 14, 0 below 9); ``equal``
    is the most equal words that such a run has. Items with the same words count as one, under
    their smallest id; ``n_items`` tells how many. Items of under 8 words never match. Null and
    empty texts on either side match nothing. Rows that share a document id share the result.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w"))
        .where(F.size("w") >= MIN_WORDS)
        .groupBy("w")
        .agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
        .select("item_id", "n_items", _hashed(F.col("w")).alias("words"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    test = _seed_rows(items, "item_id").withColumnRenamed("at", "item_at").distinct()
    if test.count() <= BROADCAST_SEEDS:
        test = F.broadcast(test)
    train = _seed_rows(texts.select("doc_id", _hashed(words_of(F.col("text"))).alias("words")), "doc_id")
    shifts = train.join(test, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    near = (
        shifts.withColumnRenamed("doc_id", "__doc")
        .join(texts, F.col("__doc").eqNullSafe(F.col("doc_id")))
        .select("doc_id", "item_id", "shift", _hashed(words_of(F.col("text"))).alias("doc_words"))
        .join(items, "item_id")
    )
    first = F.greatest(F.lit(0), -F.col("shift"))
    after = F.least(F.size("words"), F.size("doc_words") - F.col("shift"))
    same = F.transform(
        F.sequence(F.lit(0), F.col("after") - F.col("first") - 1),
        lambda i: (F.element_at("words", F.col("first") + i + 1) == F.element_at("doc_words", F.col("first") + i + F.col("shift") + 1)).cast("int"),
    )
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.size("same") - F.col("run") + 1),
            lambda s: F.aggregate(F.slice("same", s, F.col("run")), F.lit(0), lambda a, x: a + x),
        )
    )
    allowed = F.coalesce(*[F.when(F.col("run") >= n, F.lit(e)) for n, e in TOLERANCE])
    return (
        near.withColumn("run", F.least(F.lit(REACH), F.size("words")))
        .withColumn("first", first)
        .withColumn("after", after)
        .where("after - first >= run")
        .withColumn("same", same)
        .withColumn("equal", best)
        .where(F.col("equal") >= F.col("run") - allowed)
        .select("doc_id", "item_id", "n_items", "shift", "run", "equal")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document id with a verified overlap: ``doc_id, contaminated, n_items, first_item, most_equal``.

    ``n_items`` counts the test items that it overlaps, copies of an item included. An empty table
    on either side gives an empty result.
    """
    by_item = overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("n_items").alias("n_items"), F.max("equal").alias("equal"))
    return by_item.groupBy("doc_id").agg(
        F.lit(True).alias("contaminated"), F.sum("n_items").alias("n_items"), F.min("item_id").alias("first_item"), F.max("equal").alias("most_equal")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no test item, with all their columns; each text is judged on its own, whatever its id."""
    texts = docs.select(text_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    leaks = contaminated(texts, benchmark).select(F.col("doc_id").alias("leak"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("key"))
    return rows.join(leaks, F.col("key") == F.col("leak"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
