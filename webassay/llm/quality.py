"""Quality rules with thresholds that follow the data.

Every document gets exact counts. For each ratio of counts a quantile sketch
is kept per language and source: a histogram whose buckets keep the seven
leading bits of the value, so its relative error is below 1/64, two sketches
merge by adding counts, and a sketch of a language or of the corpus is the sum
of its parts. Fences come from quantiles of the sketch and are joined back:
the quartiles where both sides count, else the median and the 90 % quantile,
as most rows have none of what is counted there. No spread is assumed beyond
the width of one bucket.

Nulls and edges: a null or blank text has no words, fails the base rule and is
not kept. A null language or source counts as the empty one. Repeated rows are
judged alike, each by itself; values that tie at a quantile share its bucket.
Long texts are counted whole. Other columns are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webassay.llm import common

#: Ratio: (numerator, denominator, scale, fence below too).
RATIOS = {
    "word_len": ("word_chars", "n_words", 100, True),
    "symbols": ("n_symbols", "n_words", 10_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, False),
}
#: Quantiles, in twentieths, between which the spread is taken: with a fence below too, and without.
SPAN = {True: (5, 15), False: (10, 18)}
#: The upper quantile plus this many spreads is the fence; groups under MIN_GROUP rows use their language's sketch, then the corpus'.
FENCE, MIN_GROUP = 3, 200
SYMBOLS = "#*$%&|<>"


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeats, n = 0, len(words)
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeats += i + 3 - max(end, i)
                end = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeats


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def step(c):
        return {"doc_id": c["doc_id"], "lang": c["lang"], "source": c["source"]} | dict(zip(names, map(list, zip(*map(count_text, c["text"])))))

    return common.map_rows(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")), step, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def ratio(name: str) -> Column:
    top, bottom, scale = RATIOS[name][:3]
    return F.when(F.col(bottom) > 0, F.expr(f"{scale} * {top} div {bottom}")).otherwise(0)


def bucket(value: Column) -> Column:
    """Lower bound of the sketch bucket: the seven leading bits."""
    return F.transform(F.array(value), lambda x: F.call_function("shiftleft", F.call_function("shiftright", x, F.greatest(F.length(F.bin(x)) - 7, F.lit(0))), F.greatest(F.length(F.bin(x)) - 7, F.lit(0))))[0]


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) over rows that pass the base rule on length."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(ratio(k)).alias("bucket")) for k in RATIOS]))
    return counted.where("n_words >= 50").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge the sketches of each ``by`` group and read the quantiles of SPAN: by..., ratio, total, low, high."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "ratio")
    run = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    both = F.col("ratio").isin([k for k, v in RATIOS.items() if v[3]])
    level = lambda i: F.min(F.when(F.col("upto") * 20 >= F.col("total") * F.when(both, SPAN[True][i]).otherwise(SPAN[False][i]), F.col("bucket")))
    return run.groupBy(*by, "ratio").agg(F.max("total").alias("total"), level(0).alias("low"), level(1).alias("high"))


def fences(counted: DataFrame) -> DataFrame:
    """One row per (lang, source): the lowest and highest value that each ratio may have."""
    sketch = common.checkpoint(sketches(counted))
    own, lang, everything = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    named = lambda df, tag: df.select(*[c for c in df.columns if c not in ("total", "low", "high")], F.struct("total", "low", "high").alias(tag))
    joined = named(own, "own").join(named(lang, "by_lang"), ["lang", "ratio"]).join(named(everything, "all_rows"), "ratio")
    pick = F.when(F.col("own.total") >= MIN_GROUP, F.col("own")).when(F.col("by_lang.total") >= MIN_GROUP, F.col("by_lang")).otherwise(F.col("all_rows"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin("q.high")) - 7, F.lit(0)))
    picked = joined.select("lang", "source", "ratio", pick.alias("q")).select("lang", "source", "ratio", "q.low", (F.col("q.high") + width - 1).alias("high"), (FENCE * F.greatest(F.col("q.high") - F.col("q.low"), width)).alias("reach"))
    return picked.groupBy("lang", "source").agg(*[x for k in RATIOS for x in (F.max(F.when(F.col("ratio") == k, F.col("low") - F.col("reach"))).alias(f"{k}_min"), F.max(F.when(F.col("ratio") == k, F.col("high") + F.col("reach"))).alias(f"{k}_max"))])


def judge(docs: DataFrame) -> DataFrame:
    """All counts, ``base_failed`` and ``kept`` for each row of (doc_id, text, lang, source)."""
    counted = common.checkpoint(counts(docs))
    limits = fences(counted)
    inside = reduce(lambda a, b: a & b, [F.coalesce(ratio(k) <= F.col(f"{k}_max"), F.lit(True)) & (F.coalesce(ratio(k) >= F.col(f"{k}_min"), F.lit(True)) if v[3] else F.lit(True)) for k, v in RATIOS.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.join(limits, ["lang", "source"], "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"))


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN {s} * {t} // {b} ELSE 0 END AS {k}" for k, (t, b, s, _) in RATIOS.items())
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {k} AS x FROM r WHERE n_words >= 50" for k in RATIOS)
    both = "ratio IN (" + ", ".join(f"'{k}'" for k, v in RATIOS.items() if v[3]) + ")"
    at = lambda i: f"min(bucket) FILTER (upto * 20 >= total * CASE WHEN {both} THEN {SPAN[True][i]} ELSE {SPAN[False][i]} END)"
    level = lambda by: f"SELECT {by}ratio, max(total) AS total, {at(0)} AS low, {at(1)} AS high FROM (SELECT *, sum(n) OVER (PARTITION BY {by}ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}ratio) AS total FROM (SELECT {by}ratio, bucket, sum(n) AS n FROM sketch GROUP BY {by}ratio, bucket)) GROUP BY {by}ratio"
    pick = lambda x: f"CASE WHEN own.total >= {MIN_GROUP} THEN own.{x} WHEN by_lang.total >= {MIN_GROUP} THEN by_lang.{x} ELSE every.{x} END AS {x}"
    limits = ", ".join(f"max(low - reach) FILTER (ratio = '{k}') AS {k}_min, max(high + width - 1 + reach) FILTER (ratio = '{k}') AS {k}_max" for k in RATIOS)
    inside = " AND ".join(f"coalesce({k} <= {k}_max, true)" + (f" AND coalesce({k} >= {k}_min, true)" if v[3] else "") for k, v in RATIOS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
t AS (SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2]) AS windows FROM w),
m AS (SELECT *, CASE WHEN len(list_distinct(windows)) < len(windows) THEN list_histogram(windows) END AS h FROM t),
f AS (SELECT *, CASE WHEN h IS NULL THEN [] ELSE list_filter(range(1, len(windows) + 1), lambda i: h[windows[i]] > 1) END AS hits FROM m),
c AS (SELECT doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_distinct(flatten(list_transform(hits, lambda i: [i, i + 1, i + 2])))) AS n_repeat_words FROM f),
r AS (SELECT *, {ratios} FROM c),
sketch AS (SELECT lang, source, ratio, (x >> greatest(length(bin(x)) - 7, 0)::BIGINT) << greatest(length(bin(x)) - 7, 0)::BIGINT AS bucket, count(*) AS n FROM ({each}) GROUP BY ALL),
own AS ({level("lang, source, ")}), by_lang AS ({level("lang, ")}), every AS ({level("")}),
p AS (SELECT own.lang, own.source, own.ratio, {pick("low")}, {pick("high")} FROM own JOIN by_lang USING (lang, ratio) JOIN every USING (ratio)),
q AS (SELECT *, 1::BIGINT << greatest(length(bin(high)) - 7, 0)::BIGINT AS width FROM p),
limits AS (SELECT lang, source, {limits} FROM (SELECT *, {FENCE} * greatest(high - low, width) AS reach FROM q) GROUP BY lang, source),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r LEFT JOIN limits USING (lang, source))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept FROM j"""


SQL = _sql()
