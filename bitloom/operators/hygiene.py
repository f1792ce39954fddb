"""Joins and hygiene of teacher outputs, holdouts, batch results and the lexical baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as tx
from bitloom.operators.lexicon import lexicon, translate_by_lexicon  # noqa: F401  the lexical baseline


def source_eligible(ja: Column, en: Column) -> Column:
    """ja of 10 to 160 and en of 5 to 400 characters after stripping, ja with kana or common kanji."""
    a, b = tx.strip(ja), tx.strip(en)
    return F.length(a).between(10, 160) & F.length(b).between(5, 400) & a.rlike(tx.CJK)


def bakeoff_eligible(ja: Column) -> Column:
    return F.length(ja).between(15, 150) & ja.rlike(tx.CJK)


def teacher_reason(ja: Column, en: Column, refusal: str = tx.REFUSAL) -> Column:
    """Why a teacher's translation is unclean: blank, refusal, cjk or ratio; null if it is clean.

    ``refusal`` is the expression that a refusal's beginning meets; by default letters of any script make words.
    """
    said = tx.strip(en)
    ratio = F.length(said) / F.greatest(F.length(ja), F.lit(1))
    return (
        F.when(en.isNull() | (said == ""), "blank")
        .when(F.substring(said, 1, 40).rlike(refusal), "refusal")
        .when(tx.cjk_fraction(said) > 0.15, "cjk")
        .when(~ratio.between(0.3, 8.0), "ratio")
    )


def exclude_holdout(pairs: DataFrame, holdout: DataFrame) -> DataFrame:
    """Pairs whose ja is not in the holdout (one column, ja)."""
    return pairs.join(holdout.select("ja").distinct(), "ja", "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; aggregated before the shuffle."""
    rest = [*order, *[c for c in rows.columns if c not in keys and c not in order]]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def align_to_range(results: DataFrame, total: int) -> DataFrame:
    """(i, content) for i = 0 .. total-1; missing results are null."""
    return results.sparkSession.range(total).withColumnRenamed("id", "i").join(results, "i", "left")


def requests_jsonl(sentences: DataFrame, model: str, system: str, chunk: int = 45000) -> DataFrame:
    """Batch requests of rows (i, text): chunk number and JSON line."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
    )
    line = F.struct(F.concat(F.lit("row-"), F.col("i").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return sentences.select("i", F.floor(F.col("i") / chunk).alias("chunk"), F.to_json(line).alias("value"))


def parse_results(lines: DataFrame) -> DataFrame:
    """(i, content) of batch response lines; content is null where the envelope is malformed."""
    valid = lines.select(F.get_json_object("value", "$.custom_id").alias("id"), F.get_json_object("value", "$.response.body.choices[0].message.content").alias("content"))
    return valid.where("id IS NOT NULL").select(F.split_part("id", F.lit("-"), F.lit(2)).cast("long").alias("i"), tx.strip(F.col("content")).alias("content"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, prompt_tokens, completion_tokens) with cost_usd; null for an unknown model."""
    cost = (F.col("prompt_tokens") * F.col("usd_in") + F.col("completion_tokens") * F.col("usd_out")) / 1e6
    return usage.join(prices, "model", "left").withColumn("cost_usd", cost).drop("usd_in", "usd_out")
