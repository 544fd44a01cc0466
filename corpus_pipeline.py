"""The corpus pipeline: five training-data stages over ``documents``.

Each stage works on all rows that its predecessor kept and keeps the columns of
``documents``; the last gives the encoded corpus.  ``run`` writes each stage's
rows as Parquet to the shared folder and rereads them for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.bpe_codec import bpe_round_trip
from docmill.llm.decontaminate import drop_contaminated
from docmill.llm.exact_dedup import drop_exact_duplicates
from docmill.llm.quality import keep_good, train
from docmill.llm.simhash import drop_near_duplicates
from docmill.llm.storage import discard, settled
from docmill.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more stay.

    It learns from the labels of the documents that come in."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return drop_exact_duplicates(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents (five words, Jaccard similarity 0.8),
    which SimHash fingerprints propose, one stays."""
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and digests of ids and decoded text."""
    coded = bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage, run after the package was given to the executors."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _shipped(quality_classifier)),
    ("exact dedup", _shipped(exact_dedup)),
    ("simhash near-dedup", _shipped(near_dedup)),
    ("benchmark decontamination", _shipped(decontamination)),
    ("bpe encoding", _shipped(bpe_encoding)),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from ``documents`` on.  What a stage has
    saved is deleted when the next one's rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "pipeline")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
