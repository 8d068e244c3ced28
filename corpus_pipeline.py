"""From raw documents to token ids: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from barloom.llm.common import Stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model trained on ``labels``.

    Null and empty texts get the model's bias, which is that of a clean document, and stay. Rows with null or repeated ids are judged each by its own text; an
    empty table, or one without labelled rows, gives a model of the labels' share alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    Null counts as empty, so of all null and empty texts one row stays. A null id stays only where its text has no other. Rows repeated with one id and one
    text are told apart by nothing and stay or go together.
    """
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similarity 0.8 or more the document with the smallest doc_id.

    Texts without words, and rows with a null id, are linked with nothing and stay. Rows are told apart by id and text.
    """
    return near_dedup.drop_near_copies(docs, share=(80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents repeated or left out to reach the sources' targets, in the order of the curriculum.

    Texts without words take no room and are left out; a null source is a source; rows with null or repeated ids each take their own turns.
    """
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of each text, row by row; null text is empty and has no ids."""
    return bpe.encode_rows(docs)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", keep_one_copy), ("near_dedup", keep_one_of_near), ("mixing", mix), ("bpe", encode)]

#: SQL cannot express the trained model of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for name, step in STAGES[:-1]:
        docs = stage.table(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
