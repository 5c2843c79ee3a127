"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.functions.lineage import cut_lineage

#: Words are runs of anything but ASCII white space; nothing else about them is changed.
WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds more than this share of the rows is joined by broadcast, so fewer keys than this are.
HOT_KEYS = 1024
#: Stands for a null id where ids are ordered: null counts as the largest id.
LAST_ID = (1 << 63) - 1

__all__ = ["HOT_KEYS", "LAST_ID", "WORD", "attach", "cut_lineage", "first_of_groups", "hash60", "text_key"]


def attach(rows: DataFrame, lookup: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` and ``lookup`` (one row per ``key``) that survives hot keys.

    ``lookup`` carries in ``count`` how many of the ``total`` rows have its key. The keys above
    1/1024 of the rows, fewer than 1024 by counting, are broadcast; the rest go through a shuffle join.
    ``count`` is dropped from the result.
    """
    limit = total // HOT_KEYS
    hot = lookup.where(F.col(count) > limit).drop(count)
    cold = lookup.where(F.col(count) <= limit).drop(count)
    heated = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return heated.unionByName(rest)


def hash60(*parts: Column) -> Column:
    """60 bits of an md5 as a non-negative long; DuckDB computes the same value."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def text_key() -> Column:
    """64 bits of ``text`` (null counts as empty): judges rows whose ids are null or shared one by one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def first_of_groups(docs: DataFrame, groups_of) -> DataFrame:
    """One row of each group of texts: of its rows the one with the smallest id (null last), then the smallest text key; all columns are kept.

    ``groups_of`` turns ``doc_id, text`` into ``doc_id, component_id``. It is given text keys as
    ids, so that rows with null or shared ids are told apart. Rows equal in id and text stay once.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    groups = groups_of(docs.select(text_key().alias("doc_id"), F.col("text").cast("string").alias("text")))
    groups = cut_lineage(groups.groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grouped = attach(rows.select("id", "key"), groups, "key", total)
    keepers = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first"))
    keepers = keepers.select(F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"))
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id", "key").orderBy("row.text"))).where("turn = 1")
    kept = turned.join(keepers, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
