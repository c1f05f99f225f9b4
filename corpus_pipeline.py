"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlog.llm import bpe, minhash, mixing, quality, toxicity
from driftlog.session import save_and_reload


SIMILAR_PERCENT = 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    NULL, empty and very short texts fail the base rules; rows without doc_id
    are judged by their text; repeated rows share a verdict; without labels
    only the base rules reject.  Extra columns stay.
    """
    model = quality.train(docs, _labels(spark, sf_dir).filter("quality = 1"))
    return quality.keep_good(docs, model)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic, at 0.5 or more, go.

    A NULL or empty text is clean; repeated rows share a score; without labels
    the voters alone decide.  Extra columns stay.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts are linked at a
    similarity of ``SIMILAR_PERCENT`` of their five-word shingles.

    The least doc_id stays, with its repeated rows; empty texts and rows
    without doc_id all stay.  Extra columns stay.
    """
    return minhash.drop_near_duplicates(docs, SIMILAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights, in blocks of words.

    A NULL source is a source; texts without words are never chosen; a source
    smaller than a block ends in part of one.  Texts may be cut at block ends,
    and a document stands once for each pass.
    """
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text is encoded and decoded again; its digests are returned, one
    row per row.  A NULL text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("bpe", token_ids),
]

# SQL has no form for the trained stages; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_and_reload(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
