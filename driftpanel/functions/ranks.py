"""Exact order statistics without a single-task global window.

A window with no partition key sorts the whole table in one task. Here the values are cut
into buckets by an approximate-quantile sketch, bucket totals are accumulated (at most
one row per group and bucket), and only the rows inside one bucket are sorted together. The
sketch decides how even the buckets are, never the result. Ties are aggregated before the
sort, so one very common value is one row.

Group columns here are features, arms, folds, or model candidates: their number is set by the
study, not by the data. The per-group tables (sketches, bucket offsets, wanted positions) are
therefore broadcast, which also keeps a large table from being shuffled by a key with a
handful of values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.functions.hashing import key_bucket
from driftpanel.functions.joins import by_key
from driftpanel.functions.lineage import cut_lineage

LEAST_BUCKETS = 8
BUCKET_ROWS = 200_000  # distinct values that one task sorts
HOT_SHARE = 256


def buckets_for(rows: int) -> int:
    """Number of buckets of a table: a power of two that grows with its rows."""
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1.0, rows / BUCKET_ROWS))))


def _sketch(value: str, buckets: int) -> Column:
    probabilities = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return F.percentile_approx(value, probabilities, F.lit(max(10_000, 20 * buckets)))


def _locate(df: DataFrame, value: str, buckets: int, name: str) -> DataFrame:
    """Binary search of ``value`` in the ascending array ``_splits``; generated code, no lambdas."""
    df = df.withColumn(name, F.lit(0))
    step = buckets // 2
    while step:
        below = F.get("_splits", F.col(name) + (step - 1)) < F.col(value)
        df = df.withColumn(name, F.col(name) + F.when(below, step).otherwise(0))
        step //= 2
    return df.drop("_splits")


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate; it has exactly one row, so it is broadcast."""
    return df.crossJoin(F.broadcast(one_row))


def with_buckets(
    df: DataFrame, value: str, group: Sequence[str] = (), buckets: int = LEAST_BUCKETS, name: str = "_bucket"
) -> DataFrame:
    """Add a bucket number that grows with ``value`` and never splits equal values.

    ``buckets`` is a power of two.
    """
    splits = df.groupBy(*group).agg(_sketch(value, buckets).alias("_splits"))
    joined = df.join(F.broadcast(splits), list(group)) if group else with_constants(df, splits)
    return _locate(joined, value, buckets, name)


def running_totals(
    table: DataFrame,
    value: str,
    measures: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<measure>`` over distinct ``value`` rows of each group.

    ``table`` holds one row per (group, value). It is read several times, so it is written once;
    the number of buckets follows from its rows unless it is given.
    """
    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    table = cut_lineage(table)
    keyed = with_buckets(table, value, group, buckets or buckets_for(table.count()))
    keys = [*group, "_bucket"]
    totals = keyed.groupBy(*keys).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])

    before = (
        Window.partitionBy(*group).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(*keys).orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(F.broadcast(offsets), keys)
        .withColumns({f"cum_{m}": F.sum(m).over(inside) + F.col(f"_o_{m}") for m in measures})
        .drop("_bucket", *[f"_o_{m}" for m in measures])
    )


def mid_ranks(table: DataFrame, value: str, n: str = "n", group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Average rank of each distinct value; ``table`` has one row per (group, value) and a count."""
    ranked = running_totals(table, value, [n], group)
    return ranked.withColumn(name, F.col(f"cum_{n}") - F.col(n) + (F.col(n) + 1) / F.lit(2.0)).drop(f"cum_{n}")


def attach(rows: DataFrame, lookup: DataFrame, key: str, weight: str, columns: Sequence[str]) -> DataFrame:
    """Inner join of rows to a unique-key lookup that stays even when one key holds most rows.

    ``lookup[weight]`` is the number of rows carrying the key. Keys above 1/256 of all rows
    number fewer than 256, so they are broadcast; the rest goes through a shuffle join on the
    key and a slot. Rows that already matched get a slot of their own, which spreads them over
    all partitions without a partner. Both inputs are read more than once.
    """
    weighed = with_constants(lookup, lookup.agg(F.sum(weight).alias("_rows")))
    is_hot = F.col(weight) * HOT_SHARE > F.col("_rows")
    hot = weighed.where(is_hot).select(key, *[F.col(c).alias(f"_hot_{c}") for c in columns], F.lit(True).alias("_hot"))
    cold = weighed.where(~is_hot).select(key, F.xxhash64(key).alias("_slot"), *columns)
    slot = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key))
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("_slot", slot).join(by_key(cold), [key, "_slot"], "left")
    picked = [F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in columns]
    return joined.select(*rows.columns, *picked)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank (ties share the mean) of every row of ``df`` by ``value``; ``df`` is read twice."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranks = cut_lineage(mid_ranks(counts, value, name=name))
    return attach(df, ranks, value, "n", [name])


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], group: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Exact, linearly interpolated percentiles: one row per (group, feature, p) with ``value``.

    Values are first reduced to counts, which are written once. Bucket totals locate the wanted
    positions, and only the buckets holding one are sorted. NULL values are ignored.
    """
    keys = [*group, "feature"]
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in columns]
    counted = (
        df.select(*group, F.inline(F.array(*entries)))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counted = cut_lineage(counted)
    located = with_buckets(counted, "_v", keys, buckets or buckets_for(counted.count()))
    totals = located.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    ends = totals.withColumns(
        {
            "_end": F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)),
            "_total": F.sum("_n").over(Window.partitionBy(*keys)),
        }
    )
    targets = (
        ends.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_pos", F.col("p") * (F.col("_total") - 1))
        .withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n")))
        .groupBy(*keys, "_bucket")
        .agg(F.collect_list(F.struct("p", "_pos", (F.col("_at") - F.col("_end") + F.col("_n")).alias("_skip"))).alias("_wanted"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        located.join(F.broadcast(targets), [*keys, "_bucket"])
        .withColumn("_end", F.sum("_n").over(inside))
        .select(*keys, "_v", "_n", "_end", F.inline("_wanted"))
        .where((F.col("_skip") < F.col("_end")) & (F.col("_skip") >= F.col("_end") - F.col("_n")))
    )
    low, high = F.min("_v"), F.max("_v")
    fraction = F.first("_pos") - F.floor(F.first("_pos"))
    return hits.groupBy(*keys, "p").agg((low + (high - low) * fraction).alias("value"))


def rank_by_key(df: DataFrame, group: Sequence[str], key: str, tie: str, name: str) -> DataFrame:
    """1-based position of each row by a uniform hexadecimal key within its group.

    A group may hold a large share of all rows, so it is sorted in 4096 key buckets.
    """
    g = list(group)
    keyed = df.withColumn("_bucket", key_bucket(F.col(key)))
    counts = keyed.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*g, "_bucket").orderBy(key, tie)
    return (
        keyed.join(by_key(offsets), [*g, "_bucket"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("long"))
        .drop("_bucket", "_before")
    )
