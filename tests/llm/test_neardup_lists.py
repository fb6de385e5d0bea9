"""Lists of near-duplicate candidates: size and place in the join, counted where many documents share a core below the threshold."""

import random

import pytest
from pyspark.sql import functions as F

from webassay.llm import neardup

from test_operators import docs, jaccard_components

LISTS = "key long, node long, n long, place long, component long, main long, members long"


def test_classes_of_sizes(spark):
    sizes = [*range(1, 1100), 4095, 4096, 99_999, 2**31 - 1, 2**31, 2**40 + 17]
    c = neardup.size_class(F.col("n"))
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", c.alias("c"), *[x.cast("long").alias(k) for k, x in zip(("least", "most"), neardup.bounds_of(c))]).orderBy("n").collect()
    assert all(x.least <= x.n <= x.most and x.most - x.least <= x.n / 64 for x in rows)
    assert [x.c for x in rows] == sorted(x.c for x in rows) and len({x.c for x in rows if x.n < 128}) == 127


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_pairs_are_those_of_plain_loops(spark, percent):
    r = random.Random(percent)
    rows = []
    for key in range(12):
        main = r.randrange(4)
        for node in range(60):
            n = r.choice([1, 2, 5, 40, 90, 100, 110, 127, 128, 300, 1000, 1013])
            rows.append((key, node, n, r.randrange(n), r.randrange(4), main, 60))
    want = set()
    for a in rows:
        for b in rows:
            same = a[0] == b[0] and a[4] != b[4] and a[4] != a[5] and (b[4] == b[5] or a[1] < b[1])
            if same and (100 + percent) * min(a[2] - a[3], b[2] - b[3]) >= percent * (a[2] + b[2]):
                want.add((a[1], b[1]))
    got = [tuple(x) for x in neardup.across(spark.createDataFrame(rows, LISTS), percent).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def cored(n, core, own, first=0):
    """n documents of core + own distinct word pairs, the first ones shared."""
    return [" ".join([f"c{k}" for k in range(core + 1)] + [f"d{first + i}x{k}" for k in range(own)]) for i in range(n)]


def lists_of(spark, texts, linked=()):
    """What ``across`` gets when all of ``texts`` are left to the lists by shingles; ``linked``: rows known to be one component."""
    df = docs(spark, texts)
    lists = neardup.shingle_lists(df.select(F.col("doc_id").alias("node")), df, 2, 80)
    found = spark.createDataFrame([(i, min(linked)) for i in linked], "node long, component long")
    return neardup.spanning(neardup.placed(lists, found))


@pytest.mark.parametrize("core, own", [(85, 15), (88, 12), (850, 150)])
def test_a_shared_core_below_the_threshold_makes_no_pairs(spark, core, own):
    """Twice or four times the documents, and still none that meets: neither in the lists nor in the whole."""
    for n in (200, 800) if core < 500 else (60, 120):
        split = lists_of(spark, cored(n, core, own))
        assert split.count() >= n
        assert neardup.met(neardup.seeking(split, 80)).count() == 0


def test_two_cores_meet_in_proportion(spark):
    """Half the documents have more of the core, and are one component; pairs of the halves can't link, and don't meet."""
    for n in (100, 400):
        texts = cored(n, 85, 15) + cored(n, 95, 5, n)
        split = lists_of(spark, texts, range(n, 2 * n))
        assert neardup.met(neardup.seeking(split, 80)).count() <= 4 * n
    texts = cored(70, 85, 15) + cored(70, 95, 5, 70) + cored(70, 89, 11, 140)
    got = {x.doc_id: x.component_id for x in neardup.judge(docs(spark, texts), width=2).collect()}
    assert got == dict(enumerate(jaccard_components(texts, 2, 80)))
