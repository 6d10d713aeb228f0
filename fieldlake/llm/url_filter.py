"""URL verdicts: explicit host and path rules first, else trust and distrust propagated over the host graph.

Hosts with pages that a rule allows seed a personalised PageRank along the links; hosts with pages that a rule blocks
seed a second one against them, so that distrust reaches those who link to blocked hosts. Host edges are the
absolute links of the pages and, because sites under one name vouch for each other, both ways between a host and
its parent domain. A host is blocked if its distrust makes up more than ``limit`` of its trust and distrust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import stage

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.7
TOLERANCE = 1e-4  # total change of all ranks in a round at which the rounds end
ROUNDS_PER_STAGE = 5
LIMIT = 0.5

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for a null url or one without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER_CASE), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``src, dst, n``: number of absolute links between different hosts, and 1 each way between host and parent."""
    links = (pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(
        F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))).alias("dst"))
        .select("src", F.translate("dst", UPPER, LOWER_CASE).alias("dst"))
        .groupBy("src", "dst").agg(F.count("*").alias("n")))
    names = links.select("src").unionAll(links.select("dst")).unionAll(pages.select(F.col(host))).distinct()
    parts = F.split("src", r"\.")
    # a host and all the names above it, down to two labels
    chain = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    above = (names.filter(F.size(parts) > 2).select(F.explode(F.arrays_zip(
        F.slice(chain, F.lit(1), F.size(chain) - 1).alias("low"), F.slice(chain, F.lit(2), F.size(chain)).alias("high"))).alias("e"))
        .select("e.low", "e.high").distinct())
    family = above.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionAll(
        above.select(F.col("high").alias("src"), F.col("low").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return (links.unionByName(family).filter("src <> dst and src <> '' and dst <> ''")
            .groupBy("src", "dst").agg(F.sum("n").alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several kinds at once: ``edges(kind, src, dst, n)``, ``seeds(kind, host, seed)``.

    Seeds of a kind are scaled to sum to 1. Rounds go on until the ranks' total change is below ``tolerance``; the
    change shrinks by ``damping`` a round. A walk that meets a host without edges ends there.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = stage(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("w")), "edges")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("all"))
    start = stage(seeds.join(total, "kind").select("kind", "host", ((1 - damping) * F.col("seed") / F.col("all")).alias("rank")), "seeds")
    ranks = start
    while True:
        before = ranks
        for _ in range(ROUNDS_PER_STAGE):
            moved = ranks.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("w")).alias("rank"))
            last, ranks = ranks, moved.unionAll(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks = stage(ranks, "ranks")
        both = before.select("kind", "host", (-F.col("rank")).alias("rank")).unionAll(ranks)
        change = both.groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d")).agg(F.sum("d")).first()[0] or 0.0
        if change < tolerance:
            return ranks


def verdicts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` of every row.

    Without a rule the host decides; hosts that no seed reaches, and rows without a host, are allowed. Rows with null
    or repeated ids are judged like any other; a null html has no links.
    """
    h, p = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(id).alias("id"), h.alias("host"), p.alias("path"), F.col(html).alias("html"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "said": said})
    graph = host_edges(rows, "host", "html")
    edges = (graph.withColumn("kind", F.lit("trust"))
             .unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n").withColumn("kind", F.lit("distrust"))))
    # a host's seed is the share of its pages that the rules allow, or block
    counts = rows.filter("host <> ''").groupBy("host").agg(
        F.avg((F.col("said") == "allow").cast("int")).alias("x"), F.count("*").alias("n"),
        F.count(F.when(F.col("said") == "allow", 1)).alias("a"), F.count(F.when(F.col("said") == "block", 1)).alias("b"))
    seeds = counts.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("a") / F.col("n")).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("b") / F.col("n")).alias("seed"))))).filter("seed > 0")
    ranks = propagate(edges, seeds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    judged = rows.drop("html").join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    bad = F.col("distrust") > limit * (F.col("trust") + F.col("distrust"))
    return judged.select("id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
