"""Words, shingles, bottom-k sketches, directives and samples as Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE, SKETCH, MIN_WORDS, NEAR = 4, 128, 25, 0.60
WORD = r"[\p{L}\p{N}_]+"
#: Crawler names that may stand before directives.
BOTS = "googlebot|googlebot-news|bingbot|google|otherbot|robots|slurp|duckduckbot|yandex|baiduspider|applebot"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def long_enough(text: Column) -> Column:
    """Whether there are MIN_WORDS words, read no further than these."""
    return F.lower(text).rlike(rf"\A[^\p{{L}}\p{{N}}_]*+(?:[\p{{L}}\p{{N}}_]++[^\p{{L}}\p{{N}}_]++){{{MIN_WORDS - 1}}}[\p{{L}}\p{{N}}_]")


def word_count(text: Column) -> Column:
    """White space tokens that hold at least one word sign."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"[\p{L}\p{N}_]")))


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Joined windows of ``size`` words; all words as one if there are fewer."""
    last = F.greatest(F.size(w) - size, F.lit(0))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)])))


def feature(s: Column) -> Column:
    """64 bits as 16 hexadecimal digits, which sort as unsigned numbers."""
    return F.substring(F.md5(s), 1, 16)


def content_hash(text: Column) -> Column:
    """128 bits of the text without regard to case and white space; empty for short texts."""
    return F.when(~long_enough(text), "").otherwise(F.md5(squeeze(F.lower(text))))


def sketch(text: Column, k: int = SKETCH) -> Column:
    """The k least distinct shingle hashes in order; empty for short texts."""
    none = F.array().cast("array<string>")
    return _let(words(text), lambda w: F.when(F.size(w) < MIN_WORDS, none).otherwise(F.slice(F.array_distinct(F.sort_array(F.transform(shingles(w), feature))), 1, k)))


def similarity(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity: the share of the k least hashes of the union that both sketches hold."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_let(F.slice(F.sort_array(F.array_union(a, b)), 1, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def packed(sketch: Column) -> Column:
    """A sketch as 8 bytes for each of its hashes, in its order."""
    return F.unhex(F.array_join(sketch, ""))


def similarities(a: list[bytes], b: list[bytes], k: int = SKETCH) -> np.ndarray:
    """``similarity`` of pairs of packed sketches, all at once.

    Hashes of both sides are sorted together. One that both hold stands twice
    in a row; its place in the union is its own less the doubles before it.
    """
    sizes = np.array([[len(x) // 8 for x in a], [len(x) // 8 for x in b]], np.int64).reshape(2, -1)
    width = max(1, int(sizes.max(initial=0)))
    both = np.full((len(a), 2 * width), np.iinfo(np.uint64).max, np.uint64)
    for side, n, start in ((a, sizes[0], 0), (b, sizes[1], width)):
        both[:, start : start + width][np.arange(width) < n[:, None]] = np.frombuffer(b"".join(side), ">u8")
    both.sort(axis=1)
    at, held = np.arange(2 * width - 1), sizes.sum(0)
    double = (both[:, 1:] == both[:, :-1]) & (at + 1 < held[:, None])  # not what fills short rows
    place = at - np.cumsum(double, axis=1) + double
    least = np.minimum(k, held - double.sum(1))
    return (double & (place < least[:, None])).sum(1) / np.maximum(least, 1)


def directives(values: Column) -> Column:
    """Distinct lower-case directives of an array of robots values; a leading crawler name is dropped."""

    def one(v: Column) -> Column:
        return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(v, F.lit("")), rf"(?i)^\s*(?:{BOTS})\s*:", ""), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")

    return F.array_distinct(F.flatten(F.transform(values, one)))


def sample(items: Column, n: int = 5) -> Column:
    """The first n items joined by commas, and how many more there are."""
    more = F.when(F.size(items) > n, F.concat(F.lit(" (+"), (F.size(items) - n).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), more)


def register(spark) -> None:
    """``kmv_similarity(a, b)`` as a SQL function of two sketches."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION kmv_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN
        CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(slice(sort_array(array_union(a, b)), 1, {SKETCH}), array_intersect(a, b))) / size(slice(sort_array(array_union(a, b)), 1, {SKETCH})) END"""
    )
