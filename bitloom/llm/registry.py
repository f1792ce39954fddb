"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import chat, decontaminate, digests, language, licenses, mixing, repeats, simhash, toxicity, urls
from bitloom.llm.common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda spark, sf_dir: decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op2_url_filter": _over("pages", urls.query),
        "op3_chat_format": _over("conversations", chat.query),
        "op4_repeated_passages": _over("documents", repeats.query),
        "op5_license_scan": _over("documents", licenses.query),
        "op6_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op7_language_id": _over("documents", language.query),
        "op8_mixing": _over("documents", mixing.query),
        "op9_simhash": _over("documents", simhash.query),
        "op10_fingerprints": _over("documents", digests.query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urls.SQL, "op3_chat_format": chat.SQL, "op8_mixing": mixing.SQL}
