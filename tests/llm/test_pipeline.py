"""The five stages, each against a plain version on what the stage before gave; all queries on empty tables."""

import random

import corpus_pipeline
import pytest

from webassay.llm import common, mixing, pieces, pii, queries, toxicity

from test_operators import docs, jaccard_components, prose, targets_brute

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def corpus(spark, path):
    r, texts = random.Random(2), []
    for i in range(150):
        words = [w.translate(str.maketrans("0123456789", "bcdfghjklm")) for w in prose(i, 60).split()]
        if i % 5 == 0:
            words[10:10] = ["gromps"] * 3
        if i % 7 == 0:
            words[20:20] = ["mail", f"a{i}@corp.example", "or", "10.0.0.7"]
        texts.append(" ".join(words))
    texts += texts[1:9] + [texts[11].replace(" ", "  "), texts[12] + " end"] + [None, "", " ", "word " * 2000]
    sources = [r.choice(["hot", "hot", "b", None]) for _ in texts]
    df = docs(spark, texts, None, sources)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 150, 1)], TABLES["labels"]).write.parquet(f"{path}/labels.parquet")


def test_stages_against_plain_versions(spark, tmp_path):
    corpus(spark, tmp_path)
    sf = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "pieces"]
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        before = at.collect()
        stage(spark, at, sf).write.parquet(f"{sf}/{name}")
        at_next = spark.read.parquet(f"{sf}/{name}")
        after = at_next.collect()
        assert name == "pieces" or at_next.columns == columns
        if name == "toxicity":
            scorer = toxicity.fit(at, spark.read.parquet(f"{sf}/labels.parquet"))
            want = [x for x in before if scorer(x.text) < toxicity.THRESHOLD]
            assert sorted(after, key=str) == sorted(want, key=str) and 0 < len(before) - len(after) <= 40
        if name == "near_duplicates":
            rows = sorted(before, key=lambda x: x.doc_id)
            least = jaccard_components([x.text for x in rows], 5, 80)
            want = [x for i, x in enumerate(rows) if least[i] == i]
            assert sorted(after, key=str) == sorted(want, key=str) and len(after) < len(before)
        if name == "personal_data":
            known = {x.pattern for x in pii.learn(at).collect()}
            want = [(x.doc_id, pii.masked(x.text, known)) for x in before]
            assert sorted(map(str, ((x.doc_id, x.text) for x in after))) == sorted(map(str, want))
            assert not any("@corp" in (x.text or "") for x in after) and all(x.n_chars == len(x.text or "") for x in after)
        if name == "mixing":
            sizes, taken = {}, {}
            for x in before:
                sizes[x.source] = sizes.get(x.source, 0) + len((x.text or "").split())
            for x in after:
                taken[x.source] = taken.get(x.source, 0) + len((x.text or "").split())
            assert set(after) <= set(before) and max(sum(y == x for y in after) for x in set(after)) <= 2
            assert all(abs(taken.get(s, 0) - t) <= 2000 for s, t in targets_brute(sizes).items())
        if name == "pieces":
            v = pieces.Vocabulary.load()
            for x, y in zip(sorted(before, key=lambda x: x.doc_id), sorted(after, key=lambda x: x.doc_id)):
                assert y.lossless and (x.doc_id, x.lang, x.source) == (y.doc_id, y.lang, y.source)
                assert v.decode(y.ids) == x.text and y.ids == (None if x.text is None else v.encode([x.text], [x.doc_id], pieces.ALPHA, pieces.SEED)[0].tolist())
        at = at_next
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.select("doc_id", "ids").collect())) == sorted(map(str, at.select("doc_id", "ids").collect()))


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables_give_empty_results(spark, tmp_path, name):
    for table, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_linktrust", "op12_vafile", "op13_turns")])
def test_one_row_for_each_document_whatever_the_columns(spark, tmp_path, name):
    """Nulls in any column, repeated rows, ties and extra columns with names that operators use."""
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", None, None, None), (None, "x y", "en", "s", 3), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "de", "t", 0), (4, "two texts of one id", "de", "t", 0)]
    df = spark.createDataFrame(rows, TABLES["documents"])
    for extra in ("key", "node", "n", "score", "held_out", "fingerprint", "copies", "size", "ids", "pattern", "place", "__x"):
        df = df.withColumn(extra, common.F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None)], TABLES["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(str(x.doc_id) for x in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(str(x[0]) for x in rows)


def test_mixing_keeps_columns(spark):
    df = docs(spark, ["a b c", None, "d"]).withColumn("__copies_", common.F.lit("clash")).withColumn("copies", common.F.lit("clash"))
    assert mixing.mix(df).columns == df.columns
