"""Mixing sources to target weights: nested hash thresholds from histograms, without sorting documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.llm.tables import WORD, attach, cut_lineage, hash60

#: A document is taken at most this many times.
MOST_COPIES = 3
#: Bits of the hash that one histogram resolves.
BITS = 12
HASH_BITS = 60
#: Rows of the table of sources that are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, n, target`` from ``source, source_size, n`` (one row per source).

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A target above ``most`` times its source stops there and the excess is shared again by
    weight: with sources sorted by size over weight, the sources that stop are a prefix, and the
    others get what is left by weight. The windows run over one row per source name.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("bound", (F.col("source_size") * most).cast("double"))
    )
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = (F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    share = ranked.withColumn("level", left).withColumn("stops", F.col("bound") <= F.col("level") * F.col("weight"))
    open_level = F.coalesce(F.max(F.when(~F.col("stops"), F.col("level"))).over(whole), F.lit(0.0))
    return share.select(
        "source", "source_size", "n", F.when(F.col("stops"), F.col("bound")).otherwise(open_level * F.col("weight")).alias("target")
    )


def _cells(sizes: DataFrame, level: int) -> DataFrame:
    cell = F.shiftright("hash", HASH_BITS - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)
    return sizes.groupBy("source", cell.alias("cell")).agg(
        F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, copies, below``: every document is taken ``copies`` times, and once more if its hash is under ``below``.

    ``sizes`` holds ``source, hash, size``; ``wanted`` holds ``source, source_size, target``. A
    histogram of sizes by (source, top bits of the hash) finds the cell in which the running sum
    crosses the rest of the target; only rows of that cell are counted again with the next bits,
    until it holds one hash. That last hash is taken if this comes nearer to the target.
    """
    state = wanted.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
        "source_size",
        "target",
    ).select("source", "copies", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)).alias("need"))
    state = cut_lineage(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(None).cast("long")))
    for level in range(HASH_BITS // BITS):
        undecided = state.where("below is null")
        open_sources = undecided.count()
        if open_sources == 0:
            break
        narrow = (lambda df: F.broadcast(df)) if open_sources <= BROADCAST_SOURCES else (lambda df: df)
        shift = HASH_BITS - BITS * level
        inside = sizes if level == 0 else sizes.join(narrow(undecided.select("source", "prefix")), sizes["source"].eqNullSafe(undecided["source"]) & (F.shiftright(sizes["hash"], shift) == undecided["prefix"]), "left_semi")
        running = Window.partitionBy("source").orderBy("cell")
        cells = _cells(inside, level).withColumn("upto", F.sum("size").over(running)).withColumnRenamed("source", "__source")
        crossing = cells.where("size > 0").join(narrow(undecided), F.col("__source").eqNullSafe(F.col("source"))).where("upto >= need and upto - size < need")
        step = crossing.select(
            "source",
            F.when(
                F.col("low") == F.col("high"),
                F.when(F.col("upto") - F.col("need") < F.col("need") - (F.col("upto") - F.col("size")), F.col("low") + 1).otherwise(F.col("low")),
            ).alias("new_below"),
            (F.col("need") - (F.col("upto") - F.col("size"))).alias("new_need"),
            F.shiftleft("prefix", BITS).bitwiseOR(F.col("cell")).alias("new_prefix"),
        ).withColumnRenamed("source", "__source")
        moved = undecided.join(step, undecided["source"].eqNullSafe(step["__source"]), "left")
        # A source without a crossing needs nothing more: its rest is 0.
        done = F.col("__source").isNull() & F.col("new_need").isNull()
        state = cut_lineage(
            state.where("below is not null").unionByName(
                moved.select(
                    "source",
                    "copies",
                    F.coalesce("new_need", "need").alias("need"),
                    F.coalesce("new_prefix", "prefix").alias("prefix"),
                    F.when(done, F.shiftleft("prefix", shift)).otherwise(F.col("new_below")).alias("below"),
                )
            )
        )
    return state.select("source", "copies", F.coalesce(F.col("below"), F.lit(0)).alias("below"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``docs`` (``doc_id, text, source``).

    ``size`` counts words, ``taken = copies * size``. A source's taken words miss its target by at
    most half of one document. Hashes come from the id alone, so reruns agree and rows that share an
    id are taken alike (as one document for that bound). Null and empty texts have size 0 and are
    taken as their source's whole copies say; a source of size 0 has target 0; a null source is one
    source, the last; an empty table gives an empty result.
    """
    sizes = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash")
        )
    )
    by_source = cut_lineage(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most))
    total = sizes.count()
    limits = thresholds(sizes, by_source)
    plan = by_source.join(limits.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    # Joins by key need a value for null: a flag and an empty name keep it apart from every name.
    named = plan.select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("key"), "source_size", "target", "copies", "below", "n")
    rows = sizes.select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("key"), "doc_id", "size", "hash")
    return attach(rows, cut_lineage(named), "key", total).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") + (F.col("hash") < F.col("below")).cast("long")).alias("copies"),
        ((F.col("copies") + (F.col("hash") < F.col("below")).cast("long")) * F.col("size")).alias("taken"),
    )
