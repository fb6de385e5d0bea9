"""URL filters: rules by host and path, and trust propagated over host links.

Rules decide where one fits. Elsewhere the host decides: personalised PageRank
flows from hosts of allowed pages along links (whom the trusted link to is
trusted), and in reverse from hosts of blocked pages (who links to the blocked
is distrusted). A host is blocked if its distrust is above RATIO times its
trust; a host that neither reaches is allowed.

Nulls and edges: a null url, or one without ://, has an empty host and path,
fits no rule and is allowed; it takes no part in the graph. Null html has no
links. Repeated pages count for seeds and links as often as they are there.
Ties of rules of one length go to the first by name. Other columns of pages are
not looked at. An empty table gives an empty result. Without links the ranks
are the seeds: so it is for the query on the test pages, which link to paths of
their own host only.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.llm import common

#: (rule, verdict) of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, TOLERANCE, RATIO = 0.85, 1e-6, 2.0
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>:@]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), common.UPPER, common.LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    parts = [(r, v, *r.partition("/")[::2]) for r, v in longest]
    fits = [((host == h) | host.endswith("." + h)) & path.startswith("/" + p) for _, _, h, p in parts]
    pick = lambda k: reduce(lambda c, x: c.when(x[0], F.lit(x[1][k])), list(zip(fits, parts))[1:], F.when(fits[0], F.lit(parts[0][k])))
    return pick(0), pick(1)


def propagate(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust) from links (src, dst, n) and seeds (host, allowed, blocked).

    Both directions are one iteration over rows (kind, host): trust along the
    links, distrust against them. Mass of hosts without links goes back to the
    seeds. Only two sums and one distance come to the driver in a round. A round
    shrinks that distance to DAMPING of it at most, so the iteration ends.
    """
    two = F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("b").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    ways = links.where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n")).select(two.alias("x"), "n").select("x.kind", "x.a", "x.b", "n")
    out = ways.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    ways = common.checkpoint(ways.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("share")))
    each = F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("allowed").alias("w")), F.struct(F.lit("b").alias("kind"), F.col("blocked").alias("w"))))
    start = seeds.select("host", each.alias("x")).select("x.kind", "host", "x.w").where("w > 0")
    totals = {r["kind"]: r["w"] for r in start.groupBy("kind").agg(F.sum("w").alias("w")).collect()}  # two numbers
    total = reduce(lambda c, k: F.when(F.col("kind") == k, F.lit(float(totals[k]))).otherwise(c), totals, F.lit(1.0))
    start = common.checkpoint(start.select("kind", "host", (F.col("w") / total).alias("seed")))
    ranks = start.withColumnRenamed("seed", "rank")
    if not ways.isEmpty():
        for r in count(1):
            got = ranks.join(ways, (ranks["kind"] == ways["kind"]) & (ranks["host"] == ways["a"])).groupBy(ways["kind"], F.col("b").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            if r % 5 == 1:
                got = common.checkpoint(got)
            sent = {x["kind"]: x["s"] for x in got.groupBy("kind").agg(F.sum("got").alias("s")).collect()}
            back = reduce(lambda c, k: F.when(F.col("kind") == k, F.lit(1 - DAMPING * sent.get(k, 0.0))).otherwise(c), ("t", "b"), F.lit(1.0))
            new = start.join(got, ["kind", "host"], "full").select("kind", "host", (back * F.coalesce("seed", F.lit(0.0)) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"))
            new = common.checkpoint(new)
            gap = new.withColumnRenamed("rank", "new").join(ranks, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0))))).first()[0] or 0.0
            common.forget(ranks, got)
            ranks = new
            if gap < TOLERANCE:
                break
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "b", F.col("rank")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of (page_id, url, html)."""
    parts = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    found = parts.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = found.groupBy("src", F.translate("dst", common.UPPER, common.LOWER).alias("dst")).agg(F.count("*").alias("n"))
    scores = propagate(links, seeds)
    # Rows outnumber hosts and hosts are uneven, so the planner may split a hot host or broadcast a small side.
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))
