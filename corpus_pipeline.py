"""The corpus pipeline: five stages, each of which works on all that its predecessor kept.

Counted as part of the subpackage ``bitloom.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import decontaminate, mixing, repeats, simhash, toxicity
from bitloom.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half. The model is fitted on the labelled documents that are there.

    A null or empty text has the score of the prior, and stays; without labels all stay. Every row is
    judged by its own text, equal texts alike. Here and below an empty table gives an empty one and
    columns besides COLUMNS are left out, whatever their names.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; one without an id only if all are without.

    Null texts and texts without words are copies of each other. Rows of one id with different texts
    are judged apart; rows equal in id and text stay or go together.
    """
    docs = docs.select(*COLUMNS)
    kept = simhash.near_duplicates(docs).where("_keep").select(F.col("row").alias("_row"))
    return docs.withColumn("_row", simhash.row_key()).join(kept, "_row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat, of over 50 words or of 400 bytes; those of which nothing is left go.

    Texts that are null or empty before stay; n_chars is counted anew.
    """
    left = repeats.remove_repeats(docs.select(*COLUMNS, (F.col("text") == "").alias("_empty")), words=True)
    return left.where("_empty OR text IS NULL OR text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified test item. Every row is judged by its own text, with an id or without; null texts stay."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with each document as often as the mix takes it; ``copy`` numbers the copies from 1.

    Null sources are one source; texts without words are no part of any size and are not taken.
    """
    return mixing.emit(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS, F.col("_copy").alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores, fingerprints and suffixes have no SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None
