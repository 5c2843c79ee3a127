"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.llm.tables import attach, cut_lineage

# The rules (host, path, verdict) and the name parts of hosts that seed distrust.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BLOCKED_NAMES = ("ads", "adult", "bets", "casino", "pills", "spam", "track")
DAMPING = 0.85
STEPS = 10
#: Distrust that condemns a host, in shares of what one blocked seed starts with.
THRESHOLD = 0.5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url.cast("string"), r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts, counted; links without a host stay inside theirs and carry nothing."""
    found = F.regexp_extract_all(F.col("html").cast("string"), F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"), F.lit(1))
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("dst"))
        .select("src", _lower(F.col("dst")).alias("dst"))
        .where("src != dst and src != '' and dst != ''")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def propagated(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """Personalised PageRank: ``host, rank`` from ``seeds`` (``host``, each starting with an equal part of 1) along ``src -> dst``.

    What a host without links holds is not handed on. Every step is a written table.
    """
    n_links = links.count()
    n_seeds = seeds.count()
    start = seeds.select("host", F.lit(1.0 / max(n_seeds, 1)).alias("part"))
    rank = start.select("host", ((1 - damping) * F.col("part")).alias("rank"))
    if n_links == 0 or n_seeds == 0:
        return rank
    out = links.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    shares = cut_lineage(attach(links, out, "src", n_links).select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    fan = cut_lineage(out.select("src", "n"))
    for _ in range(steps):
        giving = fan.join(rank, F.col("src") == F.col("host")).select("src", "rank", "n")
        moved = attach(shares, giving, "src", n_links).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        fixed = start.select("host", ((1 - damping) * F.col("part")).alias("rank"))
        rank = cut_lineage(moved.unionByName(fixed).groupBy("host").agg(F.sum("rank").alias("rank")))
    return rank


def blocked_host(host: Column, names: Sequence[str] = BLOCKED_NAMES) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-_0-9]+"), F.array(*[F.lit(n) for n in names]))


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked_names: Sequence[str] = BLOCKED_NAMES,
    damping: float = DAMPING,
    steps: int = STEPS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages`` (``page_id, url, html``).

    The longest rule decides. For the other urls the host does: trust flows along links from hosts
    that an allow rule covers whole (path ``/``), distrust flows against them from hosts that a block
    rule covers whole or whose name has a part of ``blocked_names``. A host is blocked when its
    distrust reaches ``threshold`` times a blocked seed's own share and exceeds its trust. Hosts
    without any evidence are allowed, so a page without a url (host and path empty) is allowed;
    null html has no links. An empty table gives an empty result.
    """
    parsed = cut_lineage(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    links = cut_lineage(host_links(pages))
    total = parsed.count()
    named = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host")))
    hosts = cut_lineage(named.unionByName(ends.select("host", F.lit(0).cast("long").alias("n"))).groupBy("host").agg(F.sum("n").alias("n")))
    whole = rule_of(F.col("host"), F.lit("/"), [r for r in rules if r[1] == "/"])
    seeds = hosts.where("host != ''").select("host", whole["verdict"].alias("v"), blocked_host(F.col("host"), blocked_names).alias("bad"))
    trusted = cut_lineage(seeds.where("v = 'allow' and not bad").select("host"))
    blocked = cut_lineage(seeds.where("v = 'block' or bad").select("host"))
    trust = propagated(trusted, links, damping, steps).withColumnRenamed("rank", "trust")
    distrust = propagated(blocked, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), damping, steps).withColumnRenamed("rank", "distrust")
    least = threshold * (1 - damping) / max(blocked.count(), 1)
    scored = (
        hosts.join(trust, "host", "left")
        .join(distrust, "host", "left")
        .select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
        .withColumn("host_verdict", F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))
    )
    return attach(parsed, cut_lineage(scored), "host", total).select(
        "page_id",
        "host",
        "path",
        rule_of(F.col("host"), F.col("path"), rules)["rule"].alias("rule"),
        F.coalesce(rule_of(F.col("host"), F.col("path"), rules)["verdict"], F.col("host_verdict")).alias("verdict"),
        "trust",
        "distrust",
    )
