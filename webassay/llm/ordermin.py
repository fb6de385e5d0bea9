"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is cut into tokens: runs of letters and digits (of at most 24 signs)
and single other signs that aren't white space. Each K neighbouring tokens
are a k-mer; a k-mer is numbered by its occurrence, so that repeats count.
The numbered k-mers are hashed and dealt by the hash to BINS bins (one
permutation, cut in as many parts). Each bin selects its TAKE least, puts
them back in text order and hashes the tuple. The fingerprint is the row of
tuple hashes, so texts are alike where they share k-mers in the same order:
that follows edit distance rather than set overlap. Two fingerprints are as
like as the share of bins, of those that either fills, whose tuples agree.

Nulls and edges: a null text is empty. Texts without tokens have an empty
fingerprint; two of those are alike (1), one of those and another not (0).
Shorter texts than K tokens are one k-mer. Repeated rows, and equal texts, have
equal fingerprints. A single document is its own next one. Null doc_ids come
last; rows of one doc_id are ordered by a hash of the text. Long texts are taken
whole: places have 30 bits. Other columns are passed on by ``with_next``, but
for names that begin with two underscores, which it uses. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webassay.llm import common
from webassay.llm.common import let

K, BIN_BITS, TAKE = 2, 6, 2
BINS = 1 << BIN_BITS
#: Trailing bits of a packed k-mer that hold its place: more places than an array of tokens can have in practice.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1
TOKEN = r"[\p{L}\p{N}]{1,24}|[^\p{L}\p{N}\s]"
#: Documents, about, in a range that one sort puts in order; ranges are as many as that takes.
RANGE_ROWS = 1_000
EMPTY = "-"


def top(x: Column) -> Column:
    """A packed item without its place."""
    return x.bitwiseAND(F.lit(~PLACE))


def runs(s: Column, key: Callable[[Column], Column]) -> Column:
    """Places (from 0) at which a new value of ``key`` begins in a sorted array, and the array's size at the end."""
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (key(s[j]) != key(s[F.greatest(j - 1, F.lit(0))])))
    return F.concat(starts, F.array(F.size(s)))


def pack(code: Column, place: Column) -> Column:
    """Leading bits of a hash, and the place in the text in the trailing ones: one number that sorts by both."""
    return top(code).bitwiseOR(place.bitwiseAND(F.lit(PLACE)))


def kmers(tokens: Column) -> Column:
    """All k-mers, packed."""
    last = F.greatest(F.size(tokens) - K, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: pack(F.xxhash64(*[F.get(tokens, i + d) for d in range(K)]), i.cast("long")))


def numbered(items: Column) -> Column:
    """Occurrence-numbered k-mers, packed: their number is hashed in. Equal k-mers stand together, in text order, once sorted."""
    once = lambda x: pack(F.xxhash64(top(x), F.lit(0)), x)

    def number(s: Column) -> Column:
        def spread(starts: Column) -> Column:
            occ = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts) - 2), lambda q: F.sequence(F.lit(0), starts[q + 1] - starts[q] - 1)))
            return F.zip_with(s, occ, lambda x, o: pack(F.xxhash64(top(x), o), x))

        return let(runs(s, top), spread)

    different = F.size(F.array_distinct(F.transform(items, top))) == F.size(items)
    return F.when(different, F.transform(items, once)).otherwise(let(F.sort_array(items), number))


def tuples(items: Column) -> Column:
    """Structs (bin, t): for each filled bin the hash of its TAKE least k-mers in text order."""
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")

    def pick(s: Column) -> Column:
        def each(starts: Column) -> Column:
            def one(q: Column) -> Column:
                least = F.slice(s, starts[q] + 1, F.least(starts[q + 1] - starts[q], F.lit(TAKE)))
                place_first = F.transform(least, lambda x: F.shiftleft(x, 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS)))
                codes = F.transform(F.sort_array(place_first), lambda x: F.shiftleft(x, PLACE_BITS))
                return F.struct(bin_of(s[starts[q]]).alias("bin"), F.xxhash64(codes).alias("t"))

            return F.transform(F.sequence(F.lit(0), F.size(starts) - 2), one)

        return let(runs(s, bin_of), each)

    return let(F.sort_array(items), pick)


def fingerprint(text: Column) -> Column:
    """BINS groups of eight hexadecimal digits, or dashes for an empty bin."""
    blank = F.lit("-" * 8)

    def write(filled: Column) -> Column:
        slots = F.map_from_entries(F.transform(filled, lambda x: F.struct(x["bin"], F.right(F.hex(x["t"]), F.lit(8)))))
        return let(slots, lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(m, b), blank)), ""))

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    return let(tokens, lambda t: F.when(F.size(t) > 0, let(tuples(let(kmers(t), numbered)), write)).otherwise(F.lit(EMPTY)))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing bins among those that a or b fills; 1 for two empty fingerprints."""

    def compare(places: Column) -> Column:
        x, y = lambda i: F.substr(a, i, F.lit(8)), lambda i: F.substr(b, i, F.lit(8))
        blank = F.lit("-" * 8)
        filled = F.size(F.filter(places, lambda i: (x(i) != blank) | (y(i) != blank)))
        equal = F.size(F.filter(places, lambda i: (x(i) != blank) & (x(i) == y(i))))
        return equal / filled

    places = F.sequence(F.lit(1), F.lit(BINS * 8), F.lit(8))
    return F.when((a == EMPTY) & (b == EMPTY), F.lit(1.0)).when((a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(compare(places))


def bounds_of(ids: DataFrame, by: list[str], parts: int) -> DataFrame:
    """by..., bounds: doc_ids that cut each group into ``parts`` ranges of about as many rows (an array of parts - 1 ids)."""
    shares = [i / parts for i in range(1, parts)] or [1.0]
    return ids.groupBy(*by).agg(F.array_distinct(F.array_sort(F.percentile_approx("doc_id", shares, max(1_000, 20 * parts)))).alias("bounds"))


def above(bounds: Column) -> Column:
    """How many of the bounds lie below the doc_id."""
    return F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``columns`` of the row that follows in descending doc_id (after the last: the first) as next_<column>.

    Rows are dealt to ranges of doc_id, and each range is sorted by itself.
    Ranges are as many as rows need, found in two steps: bounds that cut all
    rows into about the root of that number, and for each of those parts, in
    a table of its own, bounds that cut it as often again. What the last row
    of a range needs is the first row of the next range: a table with one row
    a range says which row that is and to which range it is sent along. So
    texts are shuffled once, and no task sees more than a range; only one row
    of a few numbers for each range meets in one place.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    steps = max(1, math.ceil(math.sqrt(docs.count() / RANGE_ROWS)))
    first = F.array(*map(F.lit, bounds_of(ids, [], steps).first()["bounds"] or [])).cast("array<bigint>")  # steps - 1 numbers
    fine = common.checkpoint(bounds_of(ids.withColumn("__part", above(first)), ["__part"], steps))
    # Ranges ascend as ids descend; null ids come last.
    last = F.lit((steps + 1) ** 2).cast("long")
    parted = docs.withColumns({"__part": F.when(F.col("doc_id").isNotNull(), above(first)), "__tie": F.xxhash64(columns[0])}).join(common.sized(fine), "__part", "left")
    ranged = parted.withColumn("__range", F.coalesce(last - 1 - F.col("__part") * (steps + 1) - above(F.col("bounds")), last)).drop("__part", "bounds")
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.col("__tie").alias("tie"))
    heads = ranged.groupBy("__range").agg(F.max(order).alias("__first"))
    everything = W.orderBy("__range")  # one row a range
    heads = common.checkpoint(heads.select("__range", "__first", F.coalesce(F.lag("__range").over(everything), F.max("__range").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("__before")))
    here, there = (F.struct(c.alias("to"), F.lit(x).alias("foreign")) for c, x in ((F.col("__range"), False), (F.col("__before"), True)))
    copies = F.when(order == F.col("__first"), F.array(here, there)).otherwise(F.array(here))
    sent = ranged.join(common.sized(heads), "__range").select("*", F.explode(copies).alias("__x")).select(*docs.columns, "__tie", F.col("__x.to").alias("__to"), F.col("__x.foreign").alias("__foreign"))
    w = W.partitionBy("__to").orderBy(F.col("__foreign"), F.col("doc_id").desc_nulls_last(), F.col("__tie").desc())
    return sent.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("not __foreign").drop("__tie", "__to", "__foreign")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("next_text", F.lit(1), cut))
    return (
        pairs.withColumn("edited", edited)
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    )
