"""Settings, sweeps, teachers, stores and the resumable corpus build."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as tx
from bitloom.plans import jobs
from bitloom.sources import stores


def test_settings():
    assert [jobs.coerce(x) for x in ("3", "0.5", "True", "x")] == [3, 0.5, True, "x"]
    assert jobs.set_dotted({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}}
    assert jobs.sweep(["a", "b"], [1, 2, 3], 1, 2) == [("a", 2), ("b", 1), ("b", 3)]
    assert jobs.run_jobs([3, 1, 2], lambda x: x * 2, 2) == [6, 2, 4]


def test_patience():
    waits, calls = [], []

    def call(text, effort):
        calls.append(effort)
        if len(calls) < 3:
            raise jobs.Rejected(429)
        if effort:
            raise jobs.Rejected(400)
        return {"content": text.upper()}

    assert jobs.call_patiently(call, "x", "minimal", sleep=waits.append) == {"content": "X"}
    assert waits == [2.0, 4.0] and calls == ["minimal"] * 3 + [None]

    def never(text, effort):
        raise jobs.Rejected(404)

    assert jobs.call_patiently(never, "x", None, sleep=waits.append) is None


def test_teacher_and_usage(spark):
    # a UDF that was used before must not go along with a task that names a module of the package
    spark.range(1).select(tx.normalize_text(F.lit("ａ")), tx.split_sentences(F.lit("a。b")), tx.align_ruby(F.lit("漢"), F.lit("かん"))).collect()
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i long, text string")

    def call(text, effort):
        if text == "t7":
            raise jobs.Rejected(404)
        return {"content": text + "!", "prompt_tokens": 2, "completion_tokens": 1}

    answers = jobs.ask_teacher(rows, call)
    assert {r["i"]: r["content"] for r in answers.collect()} == {i: None if i == 7 else f"t{i}!" for i in range(20)}
    assert tuple(jobs.usage(answers).first()) == (20, 38, 19, 1)


def test_scores_and_records(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "the cat sat on the mat", "the cat sat on the mat")], "id int, src string, hyp string, ref string")
    assert jobs.learned_score(pairs, None).first()["score"] is None
    assert jobs.learned_score(pairs, lambda df: df["hyp"].str.len() * 1.0).first()["score"] == 22.0
    path = str(tmp_path / "results")
    assert stores.load_results(spark, path).count() == 0
    stores.append_results(jobs.evaluate(pairs, "r", "t", 1), path, 1)
    stores.append_results(jobs.evaluate(pairs, "r", "t", 1), path, 2)
    row = stores.load_results(spark, path).where("version = 2").first()
    assert row["metrics"]["chrf"] > 99 and row["n"] == 1


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(2, [5, 6], [1, 7, 2]), (1, [4], [1, 2])], "idx long, src array<int>, tgt array<int>")
    stores.write_store(rows, str(tmp_path / "s"))
    assert [r["length"] for r in stores.read_store(spark, str(tmp_path / "s"), [2]).collect()] == [3]
    assert stores.export_binary(rows, str(tmp_path / "x")) == 2
    assert np.load(tmp_path / "x.idx.npy").tolist() == [[0, 1, 0, 2], [1, 2, 2, 3]]
    assert np.fromfile(tmp_path / "x.src.bin", np.uint16).tolist() == [4, 5, 6]


RULES = "rule_id string, level string, role string, target string, required boolean"


def test_annotation_teacher(spark):
    from bitloom.operators import annotation as an

    rules = spark.createDataFrame([("MARK", "N5", "marker", "token", True)], RULES)
    morphs = [("私", ["わたし"], "私", "PRON", True), ("は", [], "は", "PART", True)]
    rows = spark.createDataFrame([(k, "私は", morphs) for k in range(3)], f"i long, text string, morphs {an.MORPHS}")
    prompt = rows.select(jobs.user_prompt(F.col("text"), F.col("morphs"))).first()[0]
    assert prompt == "Sentence: 私は\nTokens:\n  0: 私  [PRON]  dict=私\n  1: は  [PART]  dict=は"

    def call(prompt, system, effort):
        assert "MARK(marker:token)" in system and prompt.startswith("Sentence: ")
        return {"content": '{"tokens": []}'}

    assert {r["content"] for r in jobs.ask_annotations(rows, rules, "grammar-1.0", call).collect()} == {'{"tokens": []}'}
    assert {r["content"] for r in jobs.ask_annotations(rows, rules, "x", lambda *a, **k: {"content": "no json"}).collect()} == {None}


def test_evaluation_is_one_job(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "猫", "the cat sat on the mat"), (2, "犬", "a dog")], "id int, ja string, en string")
    perfect = lambda rows: rows.join(pairs.select("id", F.col("en").alias("hyp")), "id").select("id", "hyp")
    path = str(tmp_path / "r")
    jobs.evaluate_run(pairs, perfect, "base", "t", 1, path, 1)
    jobs.evaluate_run(pairs, perfect, "base", "t", 1, path, 2)
    text = jobs.evaluate_run(pairs, perfect, "base", "t", 2, path, 3)
    assert "| base | t | 1 | 2 | 100.00 ± 0.00 |" in text


def test_progress(spark):
    seen = []
    with jobs.progress(spark, lambda done, total: seen.append((done, total)), 0.01):
        spark.range(1000).repartition(8).count()
    assert seen[-1] == (0, 0)


def test_command_line(spark, tmp_path, capsys):
    from bitloom.operators import annotation as an
    from bitloom.plans import cli

    (tmp_path / "pairs.tsv").write_text("".join(f"Hello there {i} friend\tこんにちは{i}\n" for i in range(60)), encoding="utf-8")
    (tmp_path / "c.yaml").write_text(f"sources: [{{name: a, kind: tabs, root: {tmp_path}}}]\nvalid: 5\ntest: 5\n")
    cli.main(["build", str(tmp_path / "c.yaml"), str(tmp_path / "out")])
    assert "| **all** | 60 |" in capsys.readouterr().out
    cli.main(["train-tokenizer", str(tmp_path / "out/train.jsonl"), "300", str(tmp_path / "tok")])
    cli.main(["encode", str(tmp_path / "tok"), str(tmp_path / "out/train.jsonl"), str(tmp_path / "stores")])
    assert "train: 50 pairs\nvalid: 5 pairs\ntest: 5 pairs" in capsys.readouterr().out
    known = cli.load_tokenizer(spark, str(tmp_path / "tok"))
    row = stores.read_store(spark, str(tmp_path / "stores/train")).first()
    assert known.decode(row["src"][:-1]).startswith("こんにちは") and row["tgt"][0] == 1
    wire = f"{an.HEADER}0.2{an.FIELD_SEP}grammar-1.0{an.RECORD_END}\\n{an.PARAGRAPH}{an.RECORD_END}{an.SENTENCE}0:1{an.FIELD_SEP}said{an.RECORD_END}"
    (tmp_path / "wires").write_text(wire + "\nbroken\n", encoding="utf-8")
    cli.main(["annotate", str(tmp_path / "wires")])
    out = capsys.readouterr().out
    assert '"translation":"said"' in out and "unreadable: unknown record tag" in out
    cli.main(["requests", str(tmp_path / "out/train.jsonl"), "m", str(tmp_path / "req")])
    assert spark.read.json(str(tmp_path / "req")).count() == 50


def test_reports(spark):
    from bitloom.sources import reports

    rows = spark.createDataFrame([(8000, 7732, "ja", 8.94, 15, 1.67), (8000, 7732, "en", 8.99, 15, 3.55)], "vocab int, merges int, side string, mean double, p95 int, chars_per_token double")
    assert "| 8000 | 7732 | 8.94 | 15 | 1.67 | 8.99 | 15 | 3.55 |" in reports.tokenizer_report(rows)
    rows = spark.createDataFrame([("a", 40.0, 20.0, 10, 5, 0, None), ("b", 50.0, 21.0, 10, 5, 1, 0.12)], "model string, chrf double, bleu double, prompt_tokens int, completion_tokens int, errors int, cost_usd double")
    text = reports.bakeoff_report(rows, 120)
    assert text.index("| b |") < text.index("| a |") and "$1.000" in text and "$500" in text and "| $? | $? |" in text


def test_build_resumes(spark, tmp_path):
    (tmp_path / "pairs.tsv").write_text("".join(f"Hello there {i} friend\tこんにちは{i}\n" for i in range(60)) + "Hello\tromaji\n", encoding="utf-8")
    sources = [{"name": "a", "kind": "tabs", "root": str(tmp_path)}]
    similarity = lambda df: df.withColumn("score", F.when(F.col("line_no") < 3, 0.1).otherwise(0.9))
    build = lambda **k: jobs.build_corpus(spark, sources, str(tmp_path / "out"), 5, 5, similarity=similarity, flagged=("a",), **k)
    found = build()
    total = found["funnel"].where("source = 'ALL'").first()
    assert (total["input_pairs"], total["kept"], total["script"], total["labse"]) == (61, 57, 1, 3)
    assert {r["split"]: r["count"] for r in found["splits"].groupBy("split").count().collect()} == {"train": 47, "valid": 5, "test": 5}
    (tmp_path / "pairs.tsv").unlink()
    assert build(resume=True)["splits"].count() == 57
    with pytest.raises(Exception):
        build()["splits"].count()
