"""Absorbing wide factors: projections on level indicators by conjugate gradients over sparse tables of levels.

The normal equations of the indicators have one unknown per level. Their matrix is a table: the
size of each level, and for each pair of levels of different factors how many rows have both. An iteration
joins that table with one vector per column; rows are read at the beginning and at the end only,
and the driver holds a few numbers per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.lineage import cut_lineage
from driftpanel.functions.ranks import attach

TOLERANCE = 1e-9
MOST_ROUNDS = 200


class NotConverged(RuntimeError):
    """The projections did not settle in the allowed rounds."""


def _key(number: int, factor: str) -> Column:
    return F.struct(F.lit(number).alias("f"), F.col(factor).cast("string").alias("v"))


def _each(columns: Sequence[str], make) -> list[Column]:
    return [make(i, c).alias(c) for i, c in enumerate(columns)]


def _links(table: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``key, other, weight, uses``: rows that share two levels, both ways; ``uses`` is how many links an ``other`` has."""
    pairs = []
    for i, a in enumerate(factors):
        for j, b in enumerate(factors[:i]):
            both = table.groupBy(_key(i, a).alias("x"), _key(j, b).alias("y")).agg(F.count(F.lit(1)).alias("weight"))
            sides = F.array(F.struct(F.col("x").alias("key"), F.col("y").alias("other")), F.struct(F.col("y").alias("key"), F.col("x").alias("other")))
            pairs.append(both.select(F.inline(sides), "weight"))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return cut_lineage(out)


def absorb(df: DataFrame, columns: Sequence[str], factors: Sequence[str], tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``df`` with ``columns`` replaced by their residuals on the indicators of all levels of ``factors``.

    ``df`` has no NULL in ``columns`` and ``factors`` (at least two) and is read several times. All columns are solved together, each with
    its own steps, until the scaled gradient falls by ``tolerance``; ``NotConverged`` is raised otherwise. Levels that hold a
    large share of the rows or links are joined by the skew-safe lookup.
    """
    k = len(columns)
    sums = []
    for i, f in enumerate(factors):
        sums.append(df.groupBy(_key(i, f).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(c).cast("double")) for c in columns]).alias("r")))
    state = sums[0]
    for more in sums[1:]:
        state = state.unionByName(more)
    zero = F.array_repeat(F.lit(0.0), k)
    links = _links(df, factors)
    degrees = links.groupBy(F.col("other").alias("key")).agg(F.count(F.lit(1)).alias("degree"))
    # r is the gradient, p the direction, x the solution; sizes scale the gradient
    state = cut_lineage(state.join(degrees, "key").select("key", "n", "degree", zero.alias("x"), "r", F.transform("r", lambda v: v / F.col("n")).alias("p")))

    def dots(table: DataFrame, *pairs: Column) -> list[list[float]]:
        row = table.agg(*[F.coalesce(F.sum(pair[i]), F.lit(0.0)) for pair in pairs for i in range(k)]).first()
        return [list(row[j * k : j * k + k]) for j in range(len(pairs))]

    product = lambda a, b: F.zip_with(a, b, lambda x, y: x * y / F.col("n"))
    (size,) = dots(state, product("r", "r"))
    first = list(size)
    for _ in range(most_rounds):
        open_columns = [s > tolerance * tolerance * f for s, f in zip(size, first)]
        if not any(open_columns):
            break
        carried = attach(links, state.select(F.col("key").alias("other"), "p", "degree"), "other", "degree", ["p"])
        met = carried.groupBy("key").agg(F.array(*[F.sum(F.col("weight") * F.col("p")[i]) for i in range(k)]).alias("met"))
        q = F.zip_with("met", "p", lambda m, v: m + F.col("n") * v)
        moved = cut_lineage(state.join(met, "key").withColumn("q", q))
        # the size is taken from r itself each time: carried along by its recurrence it would drift away
        along, size, rq, qq = dots(moved, F.zip_with("p", "q", lambda a, b: a * b), product("r", "r"), product("r", "q"), product("q", "q"))
        step = [s / a if o and a > 0 else 0.0 for s, a, o in zip(size, along, open_columns)]
        after = [max(s - 2 * t * x + t * t * y, 0.0) for s, t, x, y in zip(size, step, rq, qq)]
        turn = [b / s if o and s > 0 else 0.0 for b, s, o in zip(after, size, open_columns)]
        steps, turns = (F.array(*[F.lit(float(t)) for t in ts]) for ts in (step, turn))
        scaled = lambda a, b, sign: F.zip_with(a, F.zip_with(b, steps, lambda v, t: v * t), lambda v, w: v + sign * w)
        state = moved.select("key", "n", "degree", scaled("x", "p", 1.0).alias("x"), scaled("r", "q", -1.0).alias("r"), "p")
        state = state.withColumn("p", F.zip_with(F.transform("r", lambda v: v / F.col("n")), F.zip_with("p", turns, lambda v, t: v * t), lambda v, w: v + w))
        size = after
    else:
        raise NotConverged(f"absorbing {list(factors)} did not settle in {most_rounds} rounds")
    solved = cut_lineage(state.select("key", "n", "x"))
    out = df
    for i, f in enumerate(factors):
        mine = solved.where(F.col("key.f") == i).select(F.col("key.v").alias("_level"), "n", F.col("x").alias("_x"))
        out = attach(out.withColumn("_level", F.col(f).cast("string")), mine, "_level", "n", ["_x"])
        out = out.withColumns({c: F.col(c) - F.col("_x")[j] for j, c in enumerate(columns)}).drop("_x", "_level")
    return out
