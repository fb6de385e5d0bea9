"""A training corpus from the documents table, in five stages.

Each stage works on all rows that the one before kept, is written as Parquet
and read again; what it decides takes effect. All but the last return the
columns of documents:

1. toxicity: rows that score at or above the threshold go;
2. near_duplicates: of each group of near copies (five-word shingles, 0.8) one row stays;
3. personal_data: spans are masked in the text;
4. mixing: rows are dropped or repeated so that sources come near their targets;
5. pieces: texts become sampled SentencePiece ids (doc_id, lang, source, ids, n_tokens, lossless).

Nulls and edges: each stage keeps the columns that it gets, whatever their
names, but for the last one. Null and empty texts aren't toxic, have no copies
and no personal data, weigh nothing in the mix (so they stay as often as their
source's share says) and become null and empty ids. Of rows that repeat a
doc_id one stays. Empty tables give an empty result. Very long texts are taken
whole by every stage.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from webassay.llm import common, mixing, neardup, pieces, pii, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_copies(docs, width=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Fitted models, sampled segmentations and rounding by hashes aren't SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written and read again below the folder that all executors share.

    What a stage wrote is deleted once the next one has read it; the folder of
    the last one holds the result and stays.
    """
    docs, before = common.read(spark, sf_dir, "documents"), None
    top = posixpath.join(common.shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = posixpath.join(top, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
