"""Command line: ``python -m bitloom.plans.cli COMMAND ...``. Thin drivers over the functions of this package.

build CONFIG OUT                  corpus build of a YAML file (sources, valid, test, seed, filters) and its report
train-tokenizer PAIRS VOCAB OUT   a tokenizer file from JSON lines of pairs
encode TOKENIZER TRAIN OUT        stores of train, and of valid.jsonl and test.jsonl if they sit beside it
requests PAIRS MODEL OUT          batch requests as JSON lines
gate ROWS RULES OUT               assembled, linted annotations of JSON lines (i, text, morphs, content)
annotate WIRES                    display JSON of wire texts, one for each line of a text file (line ends as \\n)
report RESULTS                    the table of all results
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bitloom.operators import annotation, corpus, hygiene
from bitloom.operators.tokenizer import Tokenizer, as_training_pair, encode_column, train
from bitloom.plans import jobs
from bitloom.sources import files, reports, stores


def _read(spark: SparkSession, path: str) -> str:
    """A small file's text, from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def build(spark: SparkSession, config: str, out: str) -> str:
    import yaml

    settings = yaml.safe_load(_read(spark, config))
    cfg = corpus.FilterConfig(**settings.get("filters", {}))  # an unknown name is an error
    made = jobs.build_corpus(spark, settings["sources"], out, settings.get("valid", 3000), settings.get("test", 3000), settings.get("seed", 1), cfg, resume=settings.get("resume", False))
    for split in ("train", "valid", "test"):
        files.write_pairs(made["splits"].where(F.col("split") == split).select("ja", "en"), f"{out}/{split}.jsonl")
    return reports.funnel_report(made["funnel"], made["lengths"], made["splits"])


def train_tokenizer(spark: SparkSession, pairs: str, vocab: str, out: str) -> str:
    rows = files.read_pairs(spark, pairs)
    made = train(rows.select(F.explode(F.array("ja", "en")).alias("text")).where("text IS NOT NULL"), "text", int(vocab))
    spark.createDataFrame([(made.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(out)
    return f"{made.vocab_size} tokens"


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    return Tokenizer.from_json(_read(spark, f"{path}/part-*"))


def encode(spark: SparkSession, tokenizer: str, train_path: str, out: str, longest: int = 128) -> str:
    merges = load_tokenizer(spark, tokenizer).merges
    folder, said = train_path.rsplit("/", 1)[0], []
    there = {p.rsplit("/", 1)[0].rsplit("/", 1)[-1] if "/part-" in p else p.rsplit("/", 1)[-1] for p in files.list_files(spark, folder)}
    for split, path in [("train", train_path), *((s, f"{folder}/{s}.jsonl") for s in ("valid", "test") if f"{s}.jsonl" in there)]:
        rows = files.read_pairs(spark, path).withColumn("idx", F.monotonically_increasing_id())
        both = encode_column(encode_column(rows, "ja", merges, "a"), "en", merges, "b")
        src, tgt = as_training_pair(F.col("a"), F.col("b"), longest)
        stores.write_store(both.select("idx", src.alias("src"), tgt.alias("tgt")), f"{out}/{split}")
        said.append(f"{split}: {stores.read_store(spark, f'{out}/{split}').count()} pairs")
    return "\n".join(said)


def requests(spark: SparkSession, pairs: str, model: str, out: str) -> str:
    rows = files.lines(spark, pairs).select(F.col("line_no").alias("i"), F.get_json_object("value", "$.ja").alias("text"))
    lines = hygiene.requests_jsonl(rows, model, "Translate the Japanese sentence into English.")
    lines.write.mode("overwrite").partitionBy("chunk").format("json").save(out)
    return f"{rows.count()} requests"


def gate(spark: SparkSession, rows: str, rules: str, out: str) -> str:
    known = annotation.load_ruleset(spark, annotation.RULESET_VERSIONS[0], _read(spark, rules))
    made = annotation.assemble(spark.read.schema(f"i long, text string, morphs {annotation.MORPHS}, content string").json(rows), known)
    drops, passed = annotation.gate(made, known)
    passed.write.mode("overwrite").json(out)
    return files.markdown(drops.orderBy("reason"), "Dropped") + "\n" + files.markdown(annotation.gate_report(made, passed).drop("audit_sample"), "Gate")


def annotate(spark: SparkSession, wires: str) -> str:
    rows = files.lines(spark, wires).select(F.col("line_no").alias("id"), F.replace("value", F.lit("\\n"), F.lit("\n")).alias("src"))
    shown = annotation.annotate(rows, lambda r: r.select("id", F.col("src").alias("hyp"))).orderBy("id").limit(10_000)
    return "\n".join(r["shown"] or f"unreadable: {r['error']}" for r in shown.collect())


def report(spark: SparkSession, results: str) -> str:
    return reports.results_report(stores.load_results(spark, results))


COMMANDS = {"build": build, "train-tokenizer": train_tokenizer, "encode": encode, "requests": requests, "gate": gate, "annotate": annotate, "report": report}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="bitloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("values", nargs="*")
    given = parser.parse_args(args)
    print(COMMANDS[given.command](SparkSession.builder.getOrCreate(), *given.values))


if __name__ == "__main__":
    main()
