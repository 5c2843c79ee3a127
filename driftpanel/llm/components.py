"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftpanel.llm.tables import attach, cut_lineage


def _smallest(links: DataFrame, node: str, other: str) -> DataFrame:
    return links.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("n"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links``; ``root`` is the smallest node reachable.

    Large-star points the larger neighbours of a node to its smallest neighbour, small-star the
    smaller ones; both keep connectivity, and about log(n) rounds reach stars. Each round is a
    written table, nothing but two counts and a checksum reaches the driver, and a node with very
    many links is joined by broadcast of its one row (see ``attach``). Links with a null end and
    self-links are left out; an empty table gives an empty result.
    """
    stars = cut_lineage(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        n, total = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m"))).first()
        if (n, total) == before or n == 0:
            return stars.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                stars.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            )
        before = (n, total)
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("x")).unionByName(stars.select(F.col("m").alias("u"), F.col("v").alias("x")))
        mins = both.groupBy("u").agg(F.least(F.col("u"), F.min("x")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = cut_lineage(attach(both, mins, "u", 2 * n).where("x > u").select(F.col("x").alias("v"), "m").distinct())
        count = large.count()
        down = large.select(F.col("v").alias("u"), F.col("m").alias("x"))
        least = _smallest(large, "v", "m")
        stars = cut_lineage(
            attach(down, least, "u", count)
            .where("x != m")
            .select(F.col("x").alias("v"), "m")
            .unionByName(least.select(F.col("u").alias("v"), "m"))
            .distinct()
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
