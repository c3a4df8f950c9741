"""A training-data pipeline over documents: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, line_dedup, ngram_join, packing, surrogates, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of learnable rows.

    Each row is judged by its own text, null as empty; repeated rows share their fate. Without labels of both classes all texts score
    the share of toxic labels. Extra columns stay. An empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay at their earliest place only; no document goes, though a text may become empty. See line_dedup.dedup_lines()."""
    return line_dedup.dedup_lines(docs, counts=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8), the one with the smallest doc_id.

    Null, empty and blank texts and rows without a doc_id stay; of rows that share a kept doc_id, all stay.
    """
    return ngram_join.near_duplicates_out(docs, 5, 0.8)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates take the place of personal data; all rows and columns stay. See surrogates.replace()."""
    return surrogates.replace(docs, counts=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens; null text is a piece of the end token alone. See packing.pack()."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack),
]
#: The classifier and the tokenizer are beyond SQL; tests/llm holds run() against a plain-Python chain.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written to the shared checkpoint folder and removed when the next one stands there."""
    common.checkpoint_dir(spark)
    folder, last = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        made = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(made)
        docs = spark.read.parquet(made)
        if last:
            _remove(spark, last)
        last = made
    return docs
