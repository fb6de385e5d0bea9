"""What the smallest tables don't have, held against the SQL of the queries."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from webassay.functions import text as T
from webassay.operators import duplicates, graph, rules
from webassay.plans import catalog, job
from webassay.session import checkpoint
from webassay.sources import pages as S

from test_oracles import text


def same(spark, tmp_path, name, **tables):
    """The rows of a query over small tables, which must be those of its SQL."""
    c = duckdb.connect()
    for k, rows in tables.items():
        pd.DataFrame(rows).to_parquet(tmp_path / f"{k}.parquet")
        c.execute(f"create view {k} as select * from '{tmp_path}/{k}.parquet'")
    want = c.execute(catalog.ORACLES[name]).fetchdf()
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    rows = lambda df: sorted(tuple(map(text, r)) for r in df.itertuples(index=False))
    assert rows(got) == rows(want)
    return rows(got)


def test_marked_page_with_a_blank_title_before_another(spark, tmp_path):
    page = "<html><head><title></title><title>A second title</title></head><body></body></html>"
    got = same(spark, tmp_path, "marked_page_findings", pages=[{"page_id": i, "url": f"https://a.example/{i}", "html": page} for i in (417, 497)])
    assert not [x for x in got if x[0] == "497" and x[1].startswith("title.")]
    plain = rules.findings(spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string"), rules=[r for r in rules.REGISTRY if r.category == "title"])
    assert {r.finding_id for r in plain.collect()} == {"title.multiple", "title.too_short"}


def test_audit_of_copies_at_one_and_at_several_addresses(spark, tmp_path):
    page = lambda title, text: f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{text}</p></body></html>"
    words = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, "x", "a"), (2, "x", "a"), (3, "y", "b"), (4, "z", "b"), (5, "v", "c")]
    pages = [{"page_id": i, "url": f"https://a.example/{u}", "html": page("Copy" if w != "c" else "Other", words(w))} for i, u, w in rows]
    got = same(spark, tmp_path, "audit_findings", pages=pages)
    assert ("duplicate.title", "warning", "duplicate", "", "4") in got and not [x for x in got if x[0] in ("duplicate.content", "duplicate.untranslated_localizations")]
    whole = job.audit(spark, S.fetched(spark, str(tmp_path)), root="none").findings.where("finding_id in ('duplicate.content', 'duplicate.untranslated_localizations')")
    assert [(r.finding_id, r.affected) for r in whole.collect()] == [("duplicate.content", 4)]
    hashed = lambda *clusters: duplicates.content_groups(spark.createDataFrame([("u", c, "h") for c in clusters], "url string, cluster string, content_hash string"), cluster="cluster").first()
    assert hashed("k", "k").finding_id == "duplicate.untranslated_localizations"
    assert hashed("k", "l").finding_id == hashed("k", None).finding_id == hashed(None, None).finding_id == "duplicate.content" and hashed("k") is None


def test_links_of_pages_with_one_address(spark, tmp_path):
    page = lambda *to: "<html><body>" + "".join(f'<a href="{x}">Link</a>' for x in to) + "</body></html>"
    rows = [("https://a.example/x", page("/b", "/c")), ("https://a.example/x", page("/c", "/d", "/e")), ("https://a.example/y", page("/b")), ("https://a.example/x", page())]
    got = same(spark, tmp_path, "outlinks_by_scope", pages=[{"page_id": i, "url": u, "html": h} for i, (u, h) in enumerate(rows)])
    assert got == [("0", "2", "0"), ("1", "3", "0"), ("2", "1", "0")]


def test_each_sketch_is_made_once(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    odd = [None, "", " . ", "İ " * 13, " ".join(words[:24]), " ".join(words[:25]), "-" + "--".join(words[:25]) + "-", "x" * 5000, "a b " * 20, "\n".join(words).upper(), " ".join(words), " ".join(words[:39] + ["é", "٣", "_"])]
    documents = [{"doc_id": i, "text": t} for i, t in enumerate(odd)]
    assert [r[-1] for r in sorted(same(spark, tmp_path, "doc_sketch", documents=documents), key=lambda r: int(r[0]))]
    same(spark, tmp_path, "near_duplicate_pairs", documents=documents)
    plan = catalog.QUERIES["doc_sketch"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1


def sketch_of(numbers):
    return sorted(f"{x:016x}" for x in numbers)[: T.SKETCH]


def test_packed_sketches_are_compared_as_plain_ones(spark):
    r = random.Random(4)
    some = lambda n: [r.getrandbits(64) for _ in range(n)]
    most, core = 2**64 - 1, some(128)
    sides = [[], [0], [most], [0, most], core, core[:127] + [most], core[:22], [*core[:60], *some(68)], [0, *core[:60], *some(30)], some(128)]
    pairs = [(i, sketch_of(a), sketch_of(b)) for i, (a, b) in enumerate((a, b) for a in sides for b in sides)]
    want = spark.createDataFrame(pairs, "id int, a array<string>, b array<string>").select("*", T.packed(F.col("a")).alias("pa"), T.packed(F.col("b")).alias("pb"), T.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("id").collect()
    bytes_of = lambda side: [bytes(x[side]) for x in want]
    assert T.similarities(bytes_of("pa"), bytes_of("pb")).tolist() == [x.s for x in want]
    assert T.similarities([], []).tolist() == []


def test_a_pair_of_sketches_is_compared_once_as_numbers(spark):
    """A filter on the similarity was pushed below it, and merged the lists of strings of a pair twice."""
    rows = [(i, f"h{i}", sketch_of(range(i, i + 100))) for i in range(12)]
    pairs = duplicates.near_pairs(spark.createDataFrame(rows, "key long, content_hash string, sketch array<string>"))
    assert pairs.count() == 66
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array_union" not in plan


def test_clusters_are_those_of_all_pairs_and_compare_fewer(spark, monkeypatch):
    """Groups of near copies, chains whose ends are no pair, and texts that share a core only."""
    r = random.Random(8)
    some = lambda n: [r.getrandbits(64) for _ in range(n)]
    base, core, chain, texts = some(128), some(100), sorted(some(400)), []
    texts += [base[: 128 - i % 20] + some(i % 20) for i in range(60)]
    texts += [chain[i : i + 120] for i in range(0, 240, 24)]
    texts += [core[:70] + some(58) for _ in range(20)] + [core[:100] + some(28) for _ in range(20)] + [core[:80] + some(r.choice([0, 10, 30])) for _ in range(20)] + [some(128) for _ in range(5)]
    r.shuffle(texts)
    sketched = spark.createDataFrame([(i, f"h{i}", sketch_of(x)) for i, x in enumerate(texts)], "key long, content_hash string, sketch array<string>")
    pairs = duplicates.near_pairs(sketched).select("a", "b").collect()
    want = {k: k for p in pairs for k in p}
    while any(want[a] != want[b] for a, b in pairs):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    compared, alike = [], duplicates.alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(duplicates, "alike", counted)
    assert {x.node: x.component for x in duplicates.near_clusters(sketched).collect()} == want
    assert len(set(want.values())) > 2 and sum(compared) < len(pairs) / 2


def test_rounds_over_a_graph_send_no_table_through_the_driver(spark, monkeypatch):
    """Once a round's tables are known to be small, Spark would broadcast them unless told to merge."""
    plans = []

    def watched(df):
        out = checkpoint(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "checkpoint", watched)
    nodes = spark.range(40).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 40) for i in range(40) if i % 5] + [(i, (i + 1) % 40) for i in range(0, 40, 3)], "src long, dst long").distinct()
    graph.pagerank(nodes, edges)
    rounds = plans[2:]  # after the edges with their shares, and the first ranks
    plans.clear()
    graph.components(nodes, edges)
    rounds += plans[1:]  # after the edges both ways
    assert len(rounds) > 4 and all("isFinalPlan=true" in p and "SortMergeJoin" in p and "BroadcastHashJoin" not in p.split("== Initial Plan ==")[0] for p in rounds)
