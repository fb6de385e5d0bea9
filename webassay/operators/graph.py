"""The internal link graph: redirects, PageRank, click depth, orphans, components.

Everything works on (src, dst) and (node) tables with joins and partial sums;
the driver only sees a few sums per round: tables of all nodes are merged
(``_merged``), never broadcast, as a broadcast passes through the driver once a
round. Lineage is cut by checkpoints in the shared folder every few rounds.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webassay.functions import urls as U
from webassay.session import checkpoint, forget

DAMPING, CONVERGED = 0.85, 1e-6
#: Clicks after which the depths found so far are merged into one table.
MERGE_EVERY = 10


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join in a loop that is sorted and merged however small it is."""
    return df.hint("merge")


def _ends(hops: DataFrame, n: int) -> DataFrame:
    """(url, final, moves) after as many hops as there can be, or as it takes until nothing changes: each round follows twice as many."""
    now, followed, before = hops.select("url", "final"), 1, None
    while True:
        step = now.select(F.col("url").alias("final"), F.col("final").alias("next"))
        moved = checkpoint(now.join(_merged(step), "final", "left").select("url", F.coalesce("next", "final").alias("final"), F.col("next").isNotNull().alias("moves")))
        forget(*([before] if before is not None else []))
        now, followed, before = moved.select("url", "final"), 2 * followed, moved
        if followed >= n or moved.where("moves").isEmpty():
            return moved


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(url, final) with chains followed to their end; a chain into a cycle ends where it enters it, an address on a cycle at itself.

    After as many hops as there are addresses, what still moves is on a cycle.
    The hops of cycles are then left out, so that chains end there.
    """
    hops = checkpoint(redirects.where("url <> final").groupBy("url").agg(F.min("final").alias("final")))
    n = hops.count()
    ends = _ends(hops, 2 * n)
    cycles = checkpoint(ends.where("moves").select(F.col("final").alias("url")).distinct())
    if not cycles.isEmpty():
        ends = _ends(hops.join(cycles, "url", "left_anti"), 2 * n).unionByName(cycles.select("url", F.col("url").alias("final"), F.lit(False).alias("moves")))
    return ends.select("url", "final")


def build(pages: DataFrame, outlinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node; edges: src, dst) from pages (requested_url, final_url) and outlinks (url, target).

    A link counts for where it lands. Only links between fetched pages are
    edges, once each; links to oneself are none.
    """
    norm = pages.select(U.normalize(F.col("requested_url")).alias("url"), U.normalize(F.col("final_url")).alias("final"))
    ends = resolve_redirects(norm)
    follow = lambda df, col: df.join(ends.select(F.col("url").alias(col), F.col("final").alias("__to")), col, "left").withColumn(col, F.coalesce("__to", col)).drop("__to")
    nodes = follow(norm.select(F.col("url").alias("node")), "node").distinct()
    links = outlinks.select(U.normalize(F.col("url")).alias("src"), U.normalize(F.col("target")).alias("dst"))
    edges = follow(follow(links, "src"), "dst").where("src <> dst").distinct()
    return nodes, edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float | None = CONVERGED) -> DataFrame:
    """(node, pagerank): mass of nodes without links is dealt evenly; updates are synchronous.

    Goes on until ranks move by less than ``tolerance`` in all, which a round
    shrinks to DAMPING of it at most, or for exactly ``rounds``. A round is one
    checkpoint and one sum: how far ranks moved, and what its dangling nodes
    hold for the next one.
    """
    if rounds is None and not tolerance:
        raise ValueError("state rounds or a tolerance")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = checkpoint(edges.join(degree, "src").select("src", "dst", (1.0 / F.col("out")).alias("share")))
    ranks = checkpoint(nodes.join(degree, nodes["node"] == degree["src"], "left").select("node", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = ranks.where("dangling").count() / n
    for done in count(1):
        if rounds is not None and done > rounds:
            break
        got = ranks.join(_merged(weighted), ranks["node"] == weighted["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        even = F.lit((1 - DAMPING) / n + DAMPING * lost / n)
        new = ranks.join(_merged(got), ranks["node"] == got["dst"], "left").select("node", "dangling", (even + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        new = checkpoint(new)  # each round reads the one before twice
        moved, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        forget(ranks)
        ranks = new
        if rounds is None and moved < tolerance:
            break
    return ranks.select("node", F.col("rank").alias("pagerank"))


def click_depth(nodes: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """(node, depth) of all nodes that links reach from the root, however deep; without a known root, from the shortest address near the top."""
    known = root is not None and not nodes.where(F.col("node") == root).isEmpty()
    if not known:
        top = nodes.where(F.length(F.regexp_replace("node", "[^/]", "")) <= 3).orderBy(F.length("node"), "node").first()
        if top is None:
            return nodes.select("node", F.lit(None).cast("int").alias("depth")).where("false")
        root = top[0]
    frontier = checkpoint(nodes.where(F.col("node") == root).select("node", F.lit(0).alias("depth")))
    seen = frontier
    for d in count(1):
        frontier = checkpoint(edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(_merged(seen), "node", "left_anti").select("node", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % MERGE_EVERY == 0:
            seen = checkpoint(seen.coalesce(frontier.sparkSession.sparkContext.defaultParallelism))  # else one part of the plan a click
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected, by label propagation with pointer jumping until nothing changes."""
    both = checkpoint(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels, before = nodes.select("node", F.col("node").alias("component")), None
    while True:
        near = both.join(_merged(labels), both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("least"))
        new = labels.join(_merged(near), labels["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = checkpoint(new.join(_merged(jump), "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        forget(*([before] if before is not None else []))
        labels, before = new.select("node", "component"), new
        if new.where("component <> old").isEmpty():
            break
    return labels


def orphans(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    return nodes.where(F.col("node") != root).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def metrics(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, depths: DataFrame) -> DataFrame:
    """One row per node: pagerank to 6 places, depth, links in and out."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inlinks"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outlinks"))
    joined = reduce(lambda a, b: a.join(b, "node", "left"), [ranks, depths, into, out], nodes)
    return joined.select("node", F.round(F.coalesce("pagerank", F.lit(0.0)), 6).alias("pagerank"), "depth", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.coalesce("outlinks", F.lit(0)).alias("outlinks"))


def authority_spread(per_node: DataFrame) -> Column:
    """Greatest rank over the upper median, 1 for fewer than three nodes: an aggregate of ``pagerank``.

    The upper median is a percentile of the discrete kind, so no list is gathered.
    """
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY pagerank DESC)")
    return F.round(F.when((F.count("*") < 3) | (upper == 0), 1.0).otherwise(F.max("pagerank") / upper), 2)


def summary(per_node: DataFrame, root: str) -> DataFrame:
    return per_node.agg(
        F.count("*").alias("nodes"), F.sum("outlinks").alias("edges"), F.count_if((F.col("inlinks") == 0) & (F.col("node") != root)).alias("orphans"),
        F.count_if(F.col("depth").isNull()).alias("unreachable"), F.count_if(F.col("outlinks") == 0).alias("dead_ends"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_click_depth"), authority_spread(per_node).alias("authority_spread"),
    )


def top(per_node: DataFrame, k: int = 10) -> DataFrame:
    return per_node.orderBy(F.desc("pagerank"), "node").limit(k).select("node", "pagerank")


def hreflang_clusters(pages: DataFrame) -> DataFrame:
    """(url, cluster, lang) from pages (url, lang, hreflangs: array of lang, url).

    An alternate counts if it is returned, or if it was never fetched so that
    nobody can know. x-default is no language; an entry for the page itself
    names its own language.
    """
    own = pages.select(U.normalize(F.col("url")).alias("url"), "hreflangs")
    said = own.select("url", F.explode("hreflangs").alias("h")).select("url", F.col("h.lang").alias("lang"), U.normalize(F.col("h.url")).alias("target")).where("lower(lang) <> 'x-default'")
    named = said.groupBy(F.col("target").alias("url")).agg(F.coalesce(F.min(F.when(F.col("url") == F.col("target"), F.col("lang"))), F.min("lang")).alias("lang"))
    declared = said.where("url <> target").select(F.col("url").alias("src"), F.col("target").alias("dst")).distinct()
    known = own.select(F.col("url").alias("dst")).distinct().withColumn("known", F.lit(True))
    back = declared.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("returned", F.lit(True))
    edges = declared.join(back, ["src", "dst"], "left").join(known, "dst", "left").where("returned is not null or known is null").select("src", "dst")
    members = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return components(members, edges).select(F.col("node").alias("url"), F.col("component").alias("cluster")).join(named, "url", "left")
