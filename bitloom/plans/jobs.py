"""Configuration values, sweeps of jobs, prompts, remote teachers, and the corpus build with resumable phases."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import product
from threading import Event, Thread
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import corpus, metrics
from bitloom.sources import files, reports, stores


def coerce(text: str) -> int | float | bool | str:
    """A setting's value: whole number, number, true or false, else the text itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False}.get(text.lower(), text)


def set_dotted(config: dict, key: str, value: Any) -> dict:
    """Set ``a.b.c`` in nested mappings, making those that aren't there."""
    *path, last = key.split(".")
    at = config
    for name in path:
        at = at.setdefault(name, {})
    at[last] = value
    return config


def sweep(variants: list[str], seeds: list[int], shard: int = 0, shards: int = 1) -> list[tuple[str, int]]:
    """Jobs of all variants with all seeds; of several shards every n-th."""
    return [job for k, job in enumerate(product(variants, seeds)) if k % shards == shard]


def run_jobs(jobs: list, run: Callable[[Any], Any], workers: int) -> list:
    """Results in the order of the jobs; ``workers`` run side by side (Spark jobs of threads share the cluster under FAIR)."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(run, jobs))


# --- prompts and teachers --------------------------------------------------------------------------


def rule_digest(rules: DataFrame) -> DataFrame:
    """(rule_id, line): a rule with its roles, optional ones marked, for a prompt."""
    role = F.concat("role", F.when(F.col("required"), "").otherwise("?"), F.lit(":"), "target")
    roles = F.array_join(F.array_sort(F.collect_list(role)), ", ")
    return rules.groupBy("rule_id").agg(F.concat(F.first("rule_id"), F.lit("("), roles, F.lit(")")).alias("line"))


def system_prompt(rules: DataFrame, ruleset: str) -> str:
    """What an annotation teacher is told: the answer's shape, its rules, and the inventory (at most 20000 rules)."""
    inventory = "\n".join(r["line"] for r in rule_digest(rules).orderBy("rule_id").limit(20_000).collect())
    return f"""Annotate the numbered tokens of a Japanese sentence. Answer with one JSON object and nothing else:
{{"tokens": [{{"id": 0, "gloss": "..."}}], "words": [{{"span": [0, 2], "dict": "...", "gloss": "..."}}],
"sentences": [{{"span": [0, 5], "translation": "..."}}], "grammar": [{{"rule": "...", "roles": {{"role": 0}}}}]}}
Every token has one gloss, punctuation an empty one. A span [a, b) counts tokens; sentences cover all of them
without gaps, words don't overlap. A role's target is a token's number or a span. Only these rules exist, and
their required roles must be given; optional ones end in "?" ({ruleset}):
{inventory}"""


def user_prompt(text: Column, morphs: Column) -> Column:
    """A sentence and its numbered tokens with their tags and dictionary forms."""
    line = lambda m, i: F.format_string("  %d: %s  [%s]  dict=%s", i, m["surface"], m["pos"], m["dictionary_form"])
    return F.concat_ws("\n", F.concat(F.lit("Sentence: "), text), F.lit("Tokens:"), F.array_join(F.transform(morphs, line), "\n"))


class Rejected(Exception):
    """A remote refusal with its status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def call_patiently(call: Callable[..., dict], text: str, effort: str | None, tries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """Call a teacher; on 429 and 5xx wait 2, 4, 8 ... times as long, on 400 try once more without the effort setting. None if it fails."""
    for k in range(tries):
        try:
            return call(text, effort=effort)
        except Rejected as e:
            if e.status == 400 and effort is not None:
                effort = None
            elif e.status == 429 or e.status >= 500:
                sleep(wait * 2**k)
            else:
                return None
    return None


ANSWER = "i long, content string, prompt_tokens long, completion_tokens long, error boolean"


def ask_teacher(rows: DataFrame, call: Callable[..., dict], effort: str | None = None, threads: int = 8) -> DataFrame:
    """(i, content, tokens, error) of rows (i, text); each task asks with some threads and keeps the order of its rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                answers = list(pool.map(lambda t: call_patiently(call, t, effort), part["text"]))
                get = lambda key: [(a or {}).get(key) for a in answers]  # noqa: E731, B023
                yield pd.DataFrame({
                    "i": part["i"].to_numpy(), "content": get("content"), "prompt_tokens": [x or 0 for x in get("prompt_tokens")],
                    "completion_tokens": [x or 0 for x in get("completion_tokens")], "error": [a is None for a in answers],
                })

    return rows.select("i", "text").mapInPandas(run, ANSWER)


def ask_annotations(rows: DataFrame, rules: DataFrame, ruleset: str, call: Callable[..., dict], effort: str | None = None, threads: int = 8) -> DataFrame:
    """``rows`` (i, text, morphs) with content, a teacher's JSON object; null if there is no answer or none that is one.

    ``call`` gets the prompt, ``system`` and ``effort``.
    """
    told = system_prompt(rules, ruleset)
    asked = ask_teacher(rows.select("i", user_prompt(F.col("text"), F.col("morphs")).alias("text")), lambda prompt, effort: call(prompt, system=told, effort=effort), effort, threads)
    usable = F.try_parse_json(F.col("content")).isNotNull() & F.col("content").rlike(r"^\s*\{")
    return rows.join(asked.select("i", F.when(usable, F.col("content")).alias("content")), "i", "left")


def usage(answers: DataFrame) -> DataFrame:
    """Requests, tokens and errors of answers that are there; counted from rows, so retried tasks count once."""
    return answers.agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("error").cast("long")).alias("errors"))


def learned_score(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None) -> DataFrame:
    """``rows`` (src, hyp, ref) with ``score`` of a plug-in model; null without one."""
    if scorer is None:
        return rows.withColumn("score", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def run(src: pd.Series, hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return scorer(pd.DataFrame({"src": src, "hyp": hyp, "ref": ref}))

    return rows.withColumn("score", run("src", "hyp", "ref"))


def evaluate(pairs: DataFrame, run: str, test_set: str, seed: int, beam: int = 1) -> DataFrame:
    """One result record of rows (id, hyp, ref)."""
    both = metrics.chrf(pairs).join(metrics.bleu(pairs), F.lit(True)).join(pairs.agg(F.count("*").alias("n")), F.lit(True))
    return both.select(
        F.lit(run).alias("run"), F.lit(test_set).alias("test_set"), F.lit(seed).alias("seed"), F.lit(beam).alias("beam"), "n",
        F.create_map(F.lit("chrf"), F.col("chrf"), F.lit("bleu"), F.col("bleu")).alias("metrics"), F.lit("tok:13a|smooth:exp|eff:no").alias("bleu_signature"),
    )


def evaluate_run(pairs: DataFrame, translate: Callable[[DataFrame], DataFrame], run: str, test_set: str, seed: int, path: str, version: int, beam: int = 1) -> str:
    """Translate rows (id, ja, en), score them, append the record to the results at ``path``; the report over all results there."""
    hyps = translate(pairs.select("id", F.col("ja").alias("src")))
    scored = pairs.select("id", F.col("en").alias("ref")).join(hyps, "id", "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))
    stores.append_results(evaluate(scored, run, test_set, seed, beam), path, version)
    return reports.results_report(stores.load_results(pairs.sparkSession, path))


@contextmanager
def progress(spark: SparkSession, report: Callable[[int, int], None], every: float = 5.0) -> Iterator[None]:
    """Report the tasks that are done and all tasks of the running stages, again and again while the block runs, and once at its end."""
    tracker, ended = spark.sparkContext.statusTracker(), Event()

    def watch() -> None:
        while not ended.wait(every):
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            report(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))

    thread = Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        report(0, 0)


# --- the corpus build --------------------------------------------------------------------------------


def _phase(spark: SparkSession, path: str, make: Callable[[], DataFrame], resume: bool) -> DataFrame:
    """The table at ``path``, made first unless a finished one is there and may be used."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not (resume and done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_corpus(
    spark: SparkSession, sources: list[dict], out: str, valid: int, test: int, seed: int = 1, cfg: corpus.FilterConfig | None = None,
    predict: Callable[[Column], Column] | None = None, similarity: Callable[[DataFrame], DataFrame] | None = None, flagged: tuple[str, ...] = (),
    only: set[str] | None = None, most: int | None = None, resume: bool = False,
) -> dict[str, DataFrame]:
    """Scan, funnel, semantic filter and split; each phase is a table under ``out`` that a later call can resume from.

    ``similarity`` adds a column ``score`` to pairs; only kept pairs of flagged sources are scored.
    """

    def staged() -> DataFrame:
        raw = files.union_sources(spark, sources, only, most).withColumn("doc_id", F.col("line_no"))
        return corpus.funnel_stages(raw, cfg, predict)

    first = _phase(spark, f"{out}/staged", staged, resume)

    def semantic() -> DataFrame:
        if similarity is None or not flagged:
            return first
        due = first["stage"].isNull() & first["source"].isin(*flagged)
        scored = corpus.semantic_stage(similarity(first.where(due)), F.col("score"), F.lit(True)).drop("score")
        return first.where(~due).unionByName(scored)

    judged = _phase(spark, f"{out}/judged", semantic, resume)
    kept = judged.where("stage IS NULL")
    ties = ["source_ord", "line_no"]
    splits = _phase(spark, f"{out}/splits", lambda: corpus.split_holdout(kept.select("source", *ties, "ja", "en"), valid, test, seed, [F.col("ja"), F.col("en")], ties), resume)
    return {
        "funnel": corpus.funnel_counts(judged, totals=True),
        "lengths": corpus.length_stats(kept, F.length("ja")).select(F.lit("ja").alias("side"), "*").unionByName(corpus.length_stats(kept, F.length("en")).select(F.lit("en").alias("side"), "*")),
        "splits": splits,
    }
