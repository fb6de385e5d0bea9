"""Duplicate titles, descriptions, headings and content; near duplicates by bottom-k sketches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from webassay.functions import text as T
from webassay.operators import graph
from webassay.session import checkpoint

#: Pairs that are compared at once, about 4 MB of hashes.
PAIRS = 1024


def groups(pages: DataFrame, value: str, key: str = "url", cluster: str | None = None) -> DataFrame:
    """(value, members, distinct_pages) of values on several pages, language variants counted once; blank values are dropped."""
    unit = F.coalesce(F.col(cluster).cast("string"), F.col(key).cast("string")) if cluster else F.col(key)
    trimmed = pages.select(F.trim(F.col(value)).alias("value"), F.col(key).alias("key"), unit.alias("unit")).where("value <> ''")
    return trimmed.groupBy("value").agg(F.count("*").alias("members"), F.count_distinct("unit").alias("distinct_pages"), F.min("key").alias("first")).where("distinct_pages > 1")


def content_groups(pages: DataFrame, key: str = "url", cluster: str | None = None) -> DataFrame:
    """Exact groups by content_hash: copies of several pages, and variants of one page that nobody translated.

    Variants lie in one cluster, all of them; a page in none is a unit of its own, even where another has its address.
    """
    variant = F.col(cluster) if cluster else F.lit(None).cast("string")
    units = F.count_distinct(variant) + F.count_if(variant.isNull())
    counted = pages.where("content_hash <> ''").groupBy("content_hash").agg(F.count("*").alias("members"), units.alias("units"), F.min(key).alias("first"))
    return counted.where("members > 1").withColumn("finding_id", F.when(F.col("units") > 1, "duplicate.content").otherwise("duplicate.untranslated_localizations"))


def sketches(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, content_hash, sketch) of texts long enough to judge.

    The filter is on the text: one on the sketch would be pushed below it, and each sketch made twice.
    """
    return docs.where(T.long_enough(F.col(text))).select(F.col(key).alias("key"), T.content_hash(F.col(text)).alias("content_hash"), T.sketch(F.col(text)).alias("sketch"))


def seeking(posted: DataFrame, threshold: float) -> DataFrame:
    """hash, key, n, m of ``posted``: hash, key, n (size of the sketch), left (how many of its hashes are as common as this one or more).

    From its place in a list a text shares ``left`` hashes at most, and needs
    threshold times the larger size. Sizes are part of what is joined on: a text
    is posted once for each size in its list that this lets it reach, so texts
    with a common core that isn't enough don't meet, however many they are.
    """
    sizes = posted.groupBy(F.col("hash").alias("h")).agg(F.collect_set("n").alias("sizes"))  # no more than a sketch has hashes
    reaches = lambda m: (F.col("left") >= threshold * F.greatest("n", m)) & (F.least("n", m) >= threshold * F.greatest("n", m))
    return posted.join(sizes, F.expr("hash = h")).withColumn("m", F.explode(F.filter("sizes", reaches))).select("hash", "key", "n", "m")


def met(posted: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of texts that meet in a list of ``posted``, each in a size that the other one seeks."""
    seekers = seeking(posted, threshold)
    return seekers.alias("x").join(seekers.alias("y"), F.expr("x.hash = y.hash and x.n = y.m and x.m = y.n and x.key < y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def lists_of(sketched: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(texts: key, sketch, n; posted: hash, key, n, left) of one text of each exact group: what ``met`` pairs.

    Lossless for any threshold above 0 and without comparing all pairs. The
    k least hashes of a pair's union are at least as many as either sketch has,
    so the sketches share threshold times the larger one's size. Then both post
    one of the shared hashes if each leaves out its ceil(threshold * size) - 1
    most common ones: a hash of a passage that many texts have is posted by
    texts that have little else.

    Sketches are packed. Lists go by a number made of the hash: where two
    hashes have the same number, texts only meet once more than they need to.
    """
    packed = sketched.select("content_hash", "key", T.packed(F.col("sketch")).alias("sketch"))
    one = checkpoint(packed.groupBy("content_hash").agg(F.min(F.struct("key", "sketch")).alias("x")).select("x.key", "x.sketch", (F.length("x.sketch") / 8).cast("int").alias("n")))
    hashes = one.select("key", "n", "sketch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("key", "n", F.xxhash64(F.substring("sketch", F.col("i") * 8 + 1, F.lit(8))).alias("hash"))
    counts = hashes.groupBy("hash").agg(F.count("*").alias("members")).where("members > 1")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("members"), F.desc("hash")))
    return one, checkpoint(hashes.join(counts, "hash").withColumn("left", rank).where(F.col("left") >= F.ceil(F.lit(threshold) * F.col("n"))).select("hash", "key", "n", "left"))


def alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose estimated similarity reaches the threshold; texts: key, sketch (packed)."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(texts.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")

    def judge(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS):
                part = batch.slice(start, PAIRS)
                s = T.similarities(part.column("sa").to_pylist(), part.column("sb").to_pylist())
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s)], names=["a", "b", "similarity"])
                yield out.filter(pa.array(s >= threshold))

    return both.mapInArrow(judge, StructType([*both.schema.fields[:2], StructField("similarity", DoubleType())]))


def near_pairs(sketched: DataFrame, threshold: float = T.NEAR) -> DataFrame:
    """(a, b, similarity) of texts whose estimated similarity reaches the threshold; one text of each exact group takes part."""
    texts, posted = lists_of(sketched, threshold)
    return alike(met(posted, threshold).distinct(), texts, threshold)


def led(seekers: DataFrame) -> DataFrame:
    """Distinct (a, b) of each text of a list and the least one among those it seeks: no more than ``seekers`` has rows."""
    leads = seekers.groupBy("hash", F.col("m").alias("n"), F.col("n").alias("m")).agg(F.min("key").alias("lead"))
    return seekers.join(leads, ["hash", "n", "m"]).where("key <> lead").select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def across(seekers: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct (a, b) that meet and lie in different components (found: node, component); of a list's main component, only those that meet others."""
    sides = ["hash", F.least("n", "m").alias("low"), F.greatest("n", "m").alias("high")]
    placed = checkpoint(seekers.join(found, seekers["key"] == found["node"], "left").select("hash", "key", "n", "m", F.coalesce("component", "key").alias("component")))
    parts = placed.groupBy(*sides, "component").agg(F.count("*").alias("k"))
    mains = parts.groupBy("hash", "low", "high").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    split = checkpoint(placed.select("*", *sides[1:]).join(mains, ["hash", "low", "high"]).select("hash", "key", "n", "m", "component", "main"))
    one, other = split.where("component <> main").alias("x"), split.alias("y")
    pairs = one.join(other, F.expr("x.hash = y.hash and x.n = y.m and x.m = y.n and x.component <> y.component and (y.component = y.main or x.key < y.key)"))
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def near_clusters(sketched: DataFrame, threshold: float = T.NEAR) -> DataFrame:
    """(node, component) of the texts in ``near_pairs``: the least that pairs connect, without making all pairs.

    The pairs of a group of near copies grow with its square. So each text is
    compared with the least one of a list first, and then only texts that meet
    and still lie in different components: a pair inside one can't change it.
    """
    texts, posted = lists_of(sketched, threshold)
    seekers = checkpoint(seeking(posted, threshold))
    linked = lambda pairs: checkpoint(alike(pairs, texts, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    grouped = lambda links: graph.components(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), links)
    star = checkpoint(led(seekers))
    links = linked(star)
    found = grouped(links)
    more = linked(across(seekers, found).join(star, ["a", "b"], "left_anti"))
    return found if more.isEmpty() else grouped(links.unionByName(more))
