"""Markdown reports of small results: the funnel, tokenizers, evaluations, a teachers' bake-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import corpus
from bitloom.sources.files import markdown, mean_and_deviation


def funnel_report(counts: DataFrame, lengths: DataFrame, splits: DataFrame, title: str = "Corpus build") -> str:
    """Drops by source and stage with totals (``funnel_counts`` with totals), lengths by side, pairs of each split."""
    drops = counts.select(
        F.when(F.col("source") == "ALL", "**all**").otherwise(F.col("source")).alias("source"), F.col("input_pairs").alias("input"), *corpus.STAGES, "kept",
        F.format_string("%.1f", 100 * F.col("keep_rate")).alias("keep %"), (F.col("source") == "ALL").alias("_last"),
    )
    parts = [
        markdown(drops.orderBy("_last", "source").drop("_last"), title),
        markdown(lengths.select("side", "mean", "p50", "p95", "max"), "Lengths in characters"),
        markdown(splits.groupBy("split").agg(F.count("*").alias("pairs")).orderBy(F.desc("split")), "Splits"),
    ]
    return "\n".join(parts)


def tokenizer_report(rows: DataFrame) -> str:
    """rows: vocab, merges, side, mean, p95, chars_per_token; a line for each vocabulary with both sides."""
    sides = [
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s} {label}")
        for s in ("ja", "en") for c, label in (("mean", "tok/sent"), ("p95", "p95"), ("chars_per_token", "char/tok"))
    ]
    formats = {f"{s} {label}": "{:.2f}" for s in ("ja", "en") for label in ("tok/sent", "char/tok")}
    return markdown(rows.groupBy("vocab", "merges").agg(*sides).orderBy("vocab"), "Tokenizers", formats)


def results_report(records: DataFrame, metrics: tuple[str, ...] = ("chrf", "bleu")) -> str:
    """Records (run, test_set, seed, beam, metrics, version): the latest of each key, mean and deviation over seeds."""
    flat = corpus.latest(records.withColumn("beam", F.coalesce("beam", F.lit(1))), ["run", "test_set", "seed", "beam"], "version")
    rolled = corpus.rollup_results(flat.select("run", "test_set", "seed", "beam", *[F.col("metrics")[m].alias(m) for m in metrics]), list(metrics))
    cells = [mean_and_deviation(F.col(f"{m}_n"), F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in metrics]
    return markdown(rolled.orderBy("run", "test_set", "beam").select("run", "test_set", "beam", "seeds", *cells), "Evaluation")


def bakeoff_report(rows: DataFrame, sentences: int) -> str:
    """rows: model, chrf, bleu, prompt_tokens, completion_tokens, errors, cost_usd (null: no price), best chrF first."""
    rate = lambda n, form: F.coalesce(F.format_string(form, F.col("cost_usd") / sentences * n), F.lit("$?"))
    shown = rows.orderBy(F.desc("chrf"), "model").select(
        "model", "chrf", "bleu", F.col("prompt_tokens").alias("in tok"), F.col("completion_tokens").alias("out tok"), "errors",
        F.when(F.col("cost_usd").isNull(), "$?").otherwise(rate(1000, "$%.3f")).alias("$/1k"), F.when(F.col("cost_usd").isNull(), "$?").otherwise(rate(500_000, "$%.0f")).alias("500k"),
    )
    return markdown(shown, f"Teachers on {sentences} sentences", {"chrf": "{:.2f}", "bleu": "{:.2f}"})
