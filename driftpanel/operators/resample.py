"""Exact bootstrap and permutation draws over a value-by-class profile.

Work and shuffle do not grow with iterations times subjects. The profile (one row per
distinct value) is numbered in value order, and counts go down a binary tree over those numbers
(``functions/sampling``): draws by binomial, class labels by hypergeometric splits, keyed by iteration
and node. A task holds one range of values; it repeats the splits on the way from the root to its
range, and then its own. So neither the size of a range nor the number of subjects changes a draw.
A range returns class sizes, rank sums, and squared ranks for each iteration; shifting those by the
sizes of the lower ranges gives the global ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from driftpanel.functions import sampling
from driftpanel.functions.ranks import running_totals
from driftpanel.operators.stats import class_names

BUCKET_VALUES = 65_536  # values of one range, a power of two
CHUNK_CELLS = 1 << 18  # counts that a task draws at a time; its memory follows from this, not from the subjects

#: Sizes of the nodes from the root to a range: height above the range, subjects, subjects of the left half.
Path = list[tuple[int, int, int]]


def _paths(bucketed: DataFrame, size, heights: int) -> DataFrame:
    """``range, path`` of every range: for each node above it ``h, size, left``, the root first."""
    totals = bucketed.groupBy("bucket").agg(F.sum(size).alias("size"))
    nodes = totals.select(F.explode(F.sequence(F.lit(0), F.lit(heights))).alias("h"), "bucket", "size")
    nodes = nodes.groupBy("h", F.expr("shiftright(bucket, h)").alias("node")).agg(F.sum("size").alias("size"))
    steps = totals.select("bucket", F.explode(F.sequence(F.lit(1), F.lit(heights))).alias("h")).withColumn("node", F.expr("shiftright(bucket, h)"))
    lefts = nodes.where("node % 2 = 0").select((F.col("h") + 1).alias("h"), (F.col("node") / 2).cast("long").alias("node"), F.col("size").alias("left"))
    found = steps.join(nodes, ["h", "node"]).join(lefts, ["h", "node"])
    return found.groupBy(F.col("bucket").alias("range")).agg(F.sort_array(F.collect_list(F.struct("h", "size", "left")), asc=False).alias("path"))


def _walk(kind: str, share: np.ndarray, path: Path, bucket: int, level: int, keys: np.ndarray) -> np.ndarray:
    """What each iteration gives to a range of the whole ``share``; ``level`` is that of the ranges."""
    for h, size, left in path:
        node, went_left = np.array([bucket >> h]), (bucket >> (h - 1)) & 1 == 0
        halves = np.array([left]), np.array([size - left])
        if kind == "bootstrap":
            to_left = sampling.left_draws(share[:, None], *halves, keys, sampling.node_keys(level + h, node))[:, 0]
        else:
            to_left = sampling.left_labels(share[:, None, :], halves[0], keys, level + h, node)[:, 0]
        share = to_left if went_left else share - to_left
    return share


def _weights(kind: str, counts: np.ndarray, totals: list[int], path: Path, bucket: int, value_levels: int, seed: int, iterations: np.ndarray) -> np.ndarray:
    """``(iterations, values, classes)`` counts that the iterations give to the values of one range."""
    values, classes = counts.shape
    keys = sampling.iteration_keys(seed, iterations)
    if kind == "permutation":
        labels = _walk(kind, np.tile(np.array(totals), (len(iterations), 1)), path, bucket, value_levels, keys)
        return sampling.spread_labels(labels, counts.sum(1), value_levels, keys, bucket << value_levels)
    # the classes of a value are the lowest levels of the tree
    bits = (classes - 1).bit_length()
    cells = np.zeros((values, 1 << bits), np.int64)
    cells[:, :classes] = counts
    levels = value_levels + bits
    draws = _walk(kind, np.full(len(iterations), sum(totals)), path, bucket, levels, keys)
    return sampling.spread_draws(draws, cells.ravel(), levels, keys, bucket << levels).reshape(len(iterations), values, -1)[:, :, :classes]


def resample(profile: DataFrame, n_classes: int, kind: str, seed: int, iterations: int, precision: bool = False) -> DataFrame:
    """One row per iteration: ``w{i}``, ``r{i}``, ``q`` as in ``rank_moments`` (and ``ap`` on request).

    The profile is read several times; callers pass one that is cheap to re-read. ``kind`` is ``bootstrap`` (subjects drawn with replacement) or ``permutation`` (classes
    shuffled over subjects). ``ap`` is the average precision of class 1 against class 0.
    """
    if kind not in ("bootstrap", "permutation"):
        raise ValueError(f"unknown kind of draw: {kind}")
    names = class_names(n_classes)
    profile = profile.select("value", *names)
    summary = profile.agg(F.count(F.lit(1)).alias("values"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    totals = [int(summary[c]) for c in names]
    value_levels = min(max(summary["values"] - 1, 0).bit_length(), BUCKET_VALUES.bit_length() - 1)
    n_buckets = math.ceil(summary["values"] / (1 << value_levels)) or 1
    if n_buckets > 1:
        numbered = running_totals(profile.withColumn("one", F.lit(1)), "value", ["one"])
        bucketed = numbered.select("value", *names, F.expr(f"shiftright(cum_one - 1, {value_levels})").cast("long").alias("bucket"))
    else:
        bucketed = profile.withColumn("bucket", F.lit(0).cast("long"))
    parallelism = profile.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, min(math.ceil(parallelism / n_buckets), math.ceil(iterations / 16)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))

    def draw(pdf: pd.DataFrame, path: Path, bucket: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        counts = pdf.sort_values("value")[names].to_numpy(np.int64)
        mine = np.arange(block, iterations, n_blocks)
        chunk = max(1, CHUNK_CELLS // max(1, counts.size))
        for begin in range(0, len(mine), chunk):
            part = mine[begin : begin + chunk]
            yield part, _weights(kind, counts, totals, path, bucket, value_levels, seed, part)

    def path_of(pdf: pd.DataFrame) -> Path:
        return [(int(x["h"]), int(x["size"]), int(x["left"])) for x in pdf["path"].iloc[0]] if len(pdf) else []

    def moments(key: tuple, pdf: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        bucket, block = int(key[0]), int(key[1])
        frames = []
        for part, w in draw(pdf, path_of(paths), bucket, block):
            size = w.sum(2)
            mid = np.cumsum(size, axis=1) - size + (size + 1) / 2.0
            frame = {"iter": part, "bucket": bucket, "q": (size * mid * mid).sum(1)}
            for c in range(n_classes):
                frame[f"w{c}"] = w[:, :, c].sum(1)
                frame[f"r{c}"] = (w[:, :, c] * mid).sum(1)
            frames.append(pd.DataFrame(frame))
        return pd.concat(frames)[["iter", "bucket", "q", *columns]]

    columns = [f"{p}{c}" for c in range(n_classes) for p in "wr"]
    types = ", ".join(f"{c} {'long' if c[0] == 'w' else 'double'}" for c in columns)
    blocks = bucketed.withColumn("block", every_block)
    grouped = blocks.groupBy("bucket", "block")
    schema = f"iter int, bucket long, q double, {types}"
    if n_buckets > 1:
        subjects = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        paths = _paths(bucketed, subjects, (n_buckets - 1).bit_length()).withColumn("range_block", every_block)
        parts = grouped.cogroup(paths.groupBy("range", "range_block")).applyInPandas(moments, schema)
    else:
        parts = grouped.applyInPandas(lambda key, pdf: moments(key, pdf, pd.DataFrame()), schema)

    # a window per iteration over its buckets, and a sum over them
    lower = Window.partitionBy("iter").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    size, rank_sum = sum(F.col(f"w{c}") for c in range(n_classes)), sum(F.col(f"r{c}") for c in range(n_classes))
    shifted = parts.withColumn("_below", F.coalesce(F.sum(size).over(lower), F.lit(0)))
    below = F.col("_below").cast("double")  # its square leaves the range of a long
    sums = [F.sum(F.col("q") + 2 * below * rank_sum + below * below * size).alias("q")]
    for c in range(n_classes):
        sums += [F.sum(f"w{c}").alias(f"w{c}"), F.sum(F.col(f"r{c}") + below * F.col(f"w{c}")).alias(f"r{c}")]
    result = shifted.groupBy("iter").agg(*sums)
    if not precision:
        return result

    def precision_part(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        bucket, block = int(key[0]), int(key[1])
        offset = above.set_index("iter")
        frames = []
        for part, w in draw(pdf, path_of(above), bucket, block):
            start = offset.loc[part]
            tp = np.cumsum(w[:, ::-1, 1], axis=1) + start["tp"].to_numpy()[:, None]
            called = np.cumsum(w[:, ::-1].sum(2), axis=1) + start["called"].to_numpy()[:, None]
            gained = (w[:, ::-1, 1] * tp / np.maximum(called, 1)).sum(1)
            frames.append(pd.DataFrame({"iter": part, "gained": gained}))
        return pd.concat(frames)

    higher = Window.partitionBy("iter").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = parts.select(
        "iter",
        "bucket",
        (F.col("iter") % n_blocks).alias("block"),
        F.coalesce(F.sum("w1").over(higher), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(size).over(higher), F.lit(0)).alias("called"),
    )
    if n_buckets > 1:
        above = above.join(paths, (F.col("bucket") == F.col("range")) & (F.col("block") == F.col("range_block"))).drop("range", "range_block")
    else:
        above = above.withColumn("path", F.expr("CAST(array() AS array<struct<h:int,size:bigint,left:bigint>>)"))
    gains = (
        blocks.groupBy("bucket", "block")
        .cogroup(above.groupBy("bucket", "block"))
        .applyInPandas(precision_part, "iter int, gained double")
        .groupBy("iter")
        .agg(F.sum("gained").alias("_gained"))
    )
    return result.join(gains, "iter").withColumn("ap", F.try_divide(F.col("_gained"), F.col("w1"))).drop("_gained")
