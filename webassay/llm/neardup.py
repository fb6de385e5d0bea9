"""Near duplicates by a signature-coordinate inverted join, confirmed on full sets.

A document's set holds its distinct shingles of ``width`` words. Documents of
equal sets form one class, and only one representative of a class goes on.
A signature has COORDS coordinates, each the hash of some minima under
independent permutations: sets of similarity s agree on a coordinate of r
minima with probability s ** r. Documents are posted under coordinate-value
pairs. A pair must collide on m coordinates or more (``design``: at the wanted
similarity all but about one pair in a million do), so each document posts only
its COORDS - m + 1 rarest ones: two such prefixes of an m-fold match share one.
The collisions of a pair that meets are then counted over whole signatures;
what reaches the match threshold is confirmed on full sets.

Groups of thousands of copies share their postings, and their pairs grow with
the square. So merging skips: first each posting list is merged with its
least member only, which finds most components; then only lists whose members
still lie in several components are merged again, and there only members
outside the list's main component with members of another one. A pair inside
a component can't change the result, so none that matters is left out. Lists
longer than SMALL that still span components (documents with a common core,
or with a common passage) aren't merged in pairs: their members are posted
anew under their shingles, rarest first, and again only by a prefix. Two sets
that reach the similarity share a shingle there, at places that leave room for
enough common ones behind. Size and place are part of what is joined on: a
member is posted once for each class of sizes that its place still lets it
reach, so sets that share a core but not enough of the rest don't meet at all.
That way is exact.

Nulls and edges: texts that are null or without words have an empty set, link
with nothing and are kept. Shorter texts than ``width`` words have one
shingle, the whole sequence. Rows that share a doc_id count as one document;
a row without doc_id is alone, its component is null and it is kept. Ties and
repeated rows are equal sets. Other columns are passed on by ``drop_copies``
whatever their names, and not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webassay.llm import common

#: Coordinates of a signature, and the share of pairs at the wanted similarity that a threshold may miss.
COORDS, MISSED = 36, 1e-6
#: Longer posting lists than this that span components are posted anew by shingles.
SMALL = 64
#: Common shingles that may be broadcast: the most frequent ones, 16 bytes each.
HEAVY = 500_000
#: Bytes of values that a step of a cell holds as Python objects.
STEP_BYTES = 4_000_000
#: Documents in a block; pairs of two blocks are compared together.
BLOCK = 64
_words: dict[bytes, int] = {}


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit codes of words, remembered while the memory stays small."""
    if len(_words) > 100_000:
        _words.clear()
    out = np.empty(len(words), np.uint64)
    get = _words.get
    for i, w in enumerate(words):
        code = get(w)
        if code is None:
            code = _words[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = code
    return out


def factor(i: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1)


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle codes of each text."""
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            codes = word_codes(text.encode("utf-8", "surrogatepass").lower().split()) if text else np.zeros(0, np.uint64)
            n = len(codes)
            m = min(width, n)
            if not n:
                out.append(codes)
                continue
            total = np.full(n - m + 1, m, np.uint64)
            for k in range(m):
                total += common.mix64(codes[k : n - m + 1 + k] + np.uint64(k)) * factor(k)
            out.append(np.unique(common.mix64(total)))
    return out


def least_hits(trials: int, chance: float) -> int:
    """The largest k with P(hits < k) <= MISSED, for hits of ``trials`` tries."""
    total = 0.0
    for k in range(trials + 1):
        total += comb(trials, k) * chance**k * (1 - chance) ** (trials - k)
        if total > MISSED:
            return k
    return trials


def design(percent: int) -> tuple[int, int, int]:
    """(minima in a coordinate, coordinates that must collide, minima that must agree) for a similarity of ``percent``."""
    s = percent / 100
    for rows in (3, 2, 1):
        if (matches := least_hits(COORDS, s**rows)) >= 1:
            return rows, matches, least_hits(COORDS * rows, s)
    raise ValueError(f"signatures of {COORDS} coordinates miss pairs at a similarity of {percent} %")


def signatures(sets: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sum, xor, coordinates, minima) of each set; those of empty sets are 0. Of each minimum one byte is kept."""
    lengths = np.array([len(s) for s in sets])
    full = np.flatnonzero(lengths)
    sums, xors = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    coords, minima = np.zeros((len(sets), COORDS), np.uint64), np.zeros((len(sets), COORDS * rows), np.uint8)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.r_[0, np.cumsum(lengths[full])[:-1]]
        with np.errstate(over="ignore"):
            sums[full] = np.add.reduceat(common.mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
            xors[full] = np.bitwise_xor.reduceat(common.mix64(flat + np.uint64(0x14057B7EF767814F)), starts)
            for c in range(COORDS):
                value = np.full(len(full), c + 1, np.uint64)
                for r in range(rows):
                    i = c * rows + r + 1
                    # Leading bits of a product order codes alike enough to a random permutation, as codes are mixed.
                    least = np.minimum.reduceat((flat ^ (flat >> np.uint64(29 + i % 7))) * factor(7919 * i), starts)
                    value = common.mix64(value * factor(1) + least)
                    minima[full, i - 1] = common.mix64(least) >> np.uint64(56)
                coords[full, c] = value
    return sums, xors, coords, minima


def features(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (hashes of the set), coords, minima."""

    def step(c):
        sets = sets_of(c["text"], width)
        sums, xors, coords, minima = signatures(sets, rows)
        return {"doc_id": c["doc_id"], "n": [len(s) for s in sets], "s1": sums.view(np.int64), "s2": xors.view(np.int64), "coords": list(coords.view(np.int64)), "minima": [m.tobytes() for m in minima]}

    return common.map_rows(docs.select("doc_id", "text"), step, "doc_id long, n long, s1 long, s2 long, coords array<long>, minima binary")


def in_cells(pairs: DataFrame, values: DataFrame, nodes: int, test) -> DataFrame:
    """The (a, b), each of them once, for which ``test`` holds on their values (node, value).

    Documents are dealt to blocks of about BLOCK by a hash, and pairs to the
    cells (block of a, block of b). A cell gets each value it needs once, so a
    dense group of pairs doesn't send a value for each pair, and a document
    with very many partners is spread over all blocks of theirs. Cells are
    small: at most BLOCK * BLOCK pairs, about.
    """
    blocks = max(1, nodes // BLOCK)
    block = lambda side: F.pmod(F.xxhash64(side), F.lit(blocks)).cast("int")
    placed = pairs.select("a", "b", block("a").alias("p"), block("b").alias("q"))
    needs = placed.select("p", "q", F.col("a").alias("node")).unionByName(placed.select("p", "q", F.col("b").alias("node"))).distinct()
    none = lambda t: F.lit(None).cast(t)
    rows = needs.join(values, "node").select("p", "q", F.lit(0).alias("kind"), F.col("node").alias("a"), none("long").alias("b"), "value").unionByName(placed.select("p", "q", F.lit(1).alias("kind"), "a", "b", none("binary").alias("value")))

    def begin():
        cell, held = [None], {}

        def step(c):
            out = {"a": [], "b": []}
            for p, q, kind, a, b, value in zip(c["p"], c["q"], c["kind"], c["a"], c["b"], c["value"]):
                if cell[0] != (p, q):
                    cell[0] = (p, q)
                    held.clear()
                if kind == 0:
                    held.setdefault(a, []).append(value)
                elif any(test(x, y) for x in held.get(a, ()) for y in held.get(b, ())):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step, lambda: []

    return common.map_rows(rows.repartition("p", "q").sortWithinPartitions("p", "q", "kind"), None, "a long, b long", text="value", final=begin, most=STEP_BYTES)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= percent * union.

    Sets are made anew where the texts are read, so that no text is sent.
    """
    nodes = common.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    n = nodes.count()
    if not n:
        return pairs
    few = F.broadcast(nodes) if n <= common.SMALL_ROWS else nodes
    sets = common.map_rows(docs.select("doc_id", "text").join(few, "doc_id", "left_semi"), lambda c: {"node": c["doc_id"], "value": [s.tobytes() for s in sets_of(c["text"], width)]}, "node long, value binary")

    def reaches(one: bytes, two: bytes) -> bool:
        x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    return in_cells(pairs, sets, n, reaches)


def coordinate_lists(reps: DataFrame, matches: int) -> DataFrame:
    """key, node, n, place 0: each document under its rarest coordinates, all but ``matches`` - 1; values of one document are left out.

    reps: node, s1, n, coords.
    """
    posted = reps.select("node", "s1", "n", F.explode("coords").alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    # The most common values are left out of the prefix; those that only one document has are the rarest and matter to nobody.
    rank = F.row_number().over(W.partitionBy("node", "s1", "n").orderBy(F.desc("members"), F.desc("key")))
    return posted.join(counts, "key").withColumn("rank", rank).where(F.col("rank") >= matches).select("key", "node", "n", F.lit(0).cast("long").alias("place"))


def shingle_lists(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, node, n, place: each of ``nodes`` (node) under the prefix of its shingles, rarest first among those of ``nodes``.

    The most common shingles, HEAVY at most, are broadcast: they come last in
    that order, so a document knows the places of its own and posts only those
    that fall into its prefix. Shingles of the core that a large group shares
    so don't go through a shuffle. The others get their places by a join.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").join(common.sized(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")

    def codes_of(c):
        sets = sets_of(c["text"], width)
        return {"node": c["doc_id"], "n": [len(s) for s in sets], "codes": [s.view(np.int64) for s in sets]}

    sets = common.checkpoint(common.map_rows(texts, codes_of, "node long, n long, codes array<long>").where("n > 0").withColumn("s1", F.xxhash64("codes")).dropDuplicates(["node", "s1", "n"]))
    counts = common.checkpoint(sets.select(F.explode("codes").alias("key")).groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    sizes = dict(counts.groupBy(F.floor(F.log2(F.col("members").cast("double"))).alias("bits")).count().collect())  # 64 rows at most
    bits = next(k for k in range(SMALL.bit_length(), 65) if sum(v for x, v in sizes.items() if x >= k) <= HEAVY)
    common_ = counts.where(F.col("members") >= F.lit(2.0**bits)).orderBy("members", "key").toArrow()  # HEAVY rows at most
    keys = common_["key"].to_numpy().astype(np.int64)
    by_key = np.argsort(keys)
    held = spark.sparkContext.broadcast((keys[by_key], by_key))

    def split(c):
        known, rank = held.value
        out = {k: [] for k in ("node", "s1", "n", "light", "heavy")}
        for node, s1, n, codes in zip(c["node"], c["s1"], c["n"], c["codes"]):
            codes = np.array(codes, np.int64)
            at = np.searchsorted(known, codes)
            at[at == len(known)] = 0
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            light, heavy = codes[~hit], codes[hit][np.argsort(rank[at[hit]])]
            out["node"].append(node)
            out["s1"].append(s1)
            out["n"].append(n)
            out["light"].append(light)
            out["heavy"].append(heavy[: max(0, n - (percent * n + 99) // 100 + 1 - len(light))])
        return out

    parts = common.checkpoint(common.map_rows(sets, split, "node long, s1 long, n long, light array<long>, heavy array<long>", text="codes"))
    own = W.partitionBy("node", "s1", "n")
    light = parts.select("node", "s1", "n", F.size("light").alias("lights"), F.explode("light").alias("key")).join(counts, "key")
    place = F.col("lights") - F.count("*").over(own) + F.row_number().over(own.orderBy("members", "key")) - 1  # shingles of no other document come first
    posted = light.withColumn("place", place).select("key", "node", "n", "place")
    heavy = parts.select("node", "n", F.size("light").alias("lights"), F.posexplode("heavy").alias("place", "key")).select("key", "node", "n", (F.col("lights") + F.col("place")).cast("long").alias("place"))
    return posted.unionByName(heavy).where(f"100 * (n - place) >= {percent} * n")


def reach(x: str, y: str, percent: int) -> str:
    """Whether enough of two sets is left from their places in a list on."""
    return f"{100 + percent} * least({x}.n - {x}.place, {y}.n - {y}.place) >= {percent} * ({x}.n + {y}.n)"


def placed(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(common.sized(found), "node", "left").select("key", "node", "n", "place", F.coalesce("component", "node").alias("component"))


def led(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each member of a list and the least one."""
    now = lists.alias("now")
    leads = now.groupBy("key").agg(F.min(F.struct("node", "n", "place")).alias("lead"))
    return now.join(leads, "key").where(f"node <> lead.node and {reach('now', 'lead', percent)}").select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()


def spanning(lists: DataFrame) -> DataFrame:
    """The lists (with component) whose members lie in several components, with their main one and their length."""
    mains = lists.groupBy("key", "component").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("members")).where("parts > 1").select("key", "main", "members")
    return lists.join(mains, "key")


def size_class(n: Column) -> Column:
    """Sizes of one class lie within a 64th of each other; below 128 each size is a class. Classes rise with the sizes: the leading seven bits and how many follow."""
    bits = F.greatest(F.length(F.bin(n)) - 7, F.lit(0))
    return (bits * 64 + F.call_function("shiftright", n, bits)).cast("long")


def bounds_of(c: Column) -> tuple[Column, Column]:
    """The least and the greatest size of a class."""
    bits = F.greatest(F.floor((c - 64) / 64), F.lit(0))
    least = (c - 64 * bits) * F.pow(F.lit(2.0), bits)
    return least, least + F.pow(F.lit(2.0), bits) - 1


def seeking(split: DataFrame, percent: int) -> DataFrame:
    """``split`` with own (its class of sizes) and partner: once for each class in its list that it can still reach.

    From a place with r = n - place shingles left, a set shares at most r with
    another one of m, so it only meets sizes with (100 + percent) * r >=
    percent * (n + m); and no smaller one than percent of its own. Where all
    that follows is a common core that isn't enough, no class is left and
    nothing is posted, however many documents have the core.
    """
    sized = split.withColumn("own", size_class(F.col("n")))
    classes = sized.groupBy(F.col("key").alias("k")).agg(F.collect_set("own").alias("classes"))  # a few hundred at most

    def reachable(c: Column) -> Column:
        least, most = bounds_of(c)
        return ((100 + percent) * (F.col("n") - F.col("place")) >= percent * (F.col("n") + least)) & (100 * most >= percent * F.col("n"))

    return sized.join(classes, F.expr("key = k")).withColumn("partner", F.explode(F.filter("classes", reachable))).drop("k", "classes")


def met(seekers: DataFrame) -> DataFrame:
    """Pairs x, y of members that meet: each outside a list's main component with those of other ones, and each in a class that the other one reaches."""
    one, other = seekers.where("component <> main").alias("x"), seekers.alias("y")
    return one.join(other, F.expr("x.key = y.key and x.own = y.partner and x.partner = y.own and x.component <> y.component and (y.component = y.main or x.node < y.node)"))


def across(split: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) in ``split`` of members outside a list's main component with those of other ones."""
    return met(seeking(split, percent)).where(reach("x", "y", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, s1, s2, coords, minima; component: s1, s2, n, component_id of each non-empty set)."""
    per, matches, agreeing = design(percent)
    rows = common.checkpoint(features(docs, width, per))
    full = rows.where("n > 0 and doc_id is not null")
    kinds = common.checkpoint(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")))
    # Rows of one doc_id tie their sets together.
    twice = full.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    tied = full.join(twice, "doc_id", "left_semi").select("doc_id", "s1", "s2", "n").join(kinds, ["s1", "s2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    reps = common.checkpoint(full.join(kinds.select(F.col("node").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"], "left_semi").select(F.col("doc_id").alias("node"), "s1", "n", "coords", "minima").dropDuplicates(["node", "s1", "n"]))
    signed, nodes = reps.select("node", F.col("minima").alias("value")), reps.count()

    def collide(one: bytes, two: bytes) -> bool:
        same = np.frombuffer(one, np.uint8) == np.frombuffer(two, np.uint8)
        return int(same.sum()) >= agreeing and int(same.reshape(-1, per).all(1).sum()) >= matches

    def counted(pairs: DataFrame) -> DataFrame:
        """Pairs with enough collisions, confirmed."""
        return confirmed(common.checkpoint(in_cells(pairs, signed, nodes, collide)), docs, width, percent)

    lists = common.checkpoint(coordinate_lists(reps, matches))
    star = common.checkpoint(led(lists, percent))
    links = common.checkpoint(counted(star))
    split = common.checkpoint(spanning(placed(lists, common.checkpoint(common.components(links)))))
    rest = common.checkpoint(split.where(F.col("members") > SMALL).select("node").distinct())
    links = common.checkpoint(links.unionByName(counted(across(split.where(F.col("members") <= SMALL), percent).join(star, ["a", "b"], "left_anti"))))
    if not rest.isEmpty():
        lists = shingle_lists(rest, docs, width, percent)
        split = common.checkpoint(spanning(placed(lists, common.checkpoint(common.components(links)))))
        links = common.checkpoint(links.unionByName(confirmed(common.checkpoint(across(split, percent)), docs, width, percent)))
    found = common.components(links.unionByName(tied))
    return rows, kinds.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component_id"))


def judge(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of (doc_id, text)."""
    rows, found = classes(docs, width, percent)
    return rows.join(found, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the row of the smallest doc_id, of repeated rows one; all rows without words or doc_id.

    Only ids are joined back, so the texts pass through once; rows that repeat
    a kept doc_id are thinned to one by a hash of the row.
    """
    gone = common.sized(common.checkpoint(judge(docs, width, percent).where("not kept").select("doc_id").distinct()))
    left = docs.join(gone, "doc_id", "left_anti")
    twice = common.sized(common.checkpoint(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")))
    once = left.join(twice, "doc_id", "left_anti")
    return once.unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"), width=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON s.doc_id = c.x"""
