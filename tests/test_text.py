"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("ＡＢＣ　１２", "ABC 12"),
        ("ｶﾀｶﾅ", "カタカナ"),
        ("a\tb\x07c", "abc"),
        ("  a   b ", "a b"),
        ("", ""),
        ("か\ue0f0\u3099", "か\u3099"),  # composed only by a second pass
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, raw, tx.normalize_text) == clean


def test_normalize_null(spark):
    assert one(spark, None, tx.normalize_text) is None


def test_scripts(spark):
    assert one(spark, "日本", tx.has_japanese) and one(spark, "ｶ", tx.has_japanese) and not one(spark, "abc", tx.has_japanese)
    assert one(spark, "abc", tx.latin_ratio) == 1.0
    assert one(spark, "日本語", tx.latin_ratio) == 0.0
    assert one(spark, "123", tx.latin_ratio) == 0.0


def test_dedup_key_ignores_case_and_spaces(spark):
    key = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(tx.dedup_key(F.col("a"), F.col("b")).alias("k")).first()["k"]
    assert key("日 本", "The Cat") == key("日本", "thecat")
    assert key("日本", "Straße") == key("日本", "STRASSE")


def test_paragraphs(spark):
    assert one(spark, " a\nb \n \n\n c\n", tx.split_paragraphs) == ["a\nb", "c"]
    assert one(spark, "  ", tx.split_paragraphs) == []


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("行こう。来た！", ["行こう。", "来た！"]),
        ("「行こう！」と言った。終わり", ["「行こう！」と言った。", "終わり"]),
        ("なし", ["なし"]),
        ("だめ。」次。", ["だめ。」", "次。"]),
        ("", []),
        ("a.b", ["a.b"]),
    ],
)
def test_sentences(text, parts):
    assert tx.sentences_of(text) == parts


def test_ruby():
    assert tx.ruby_of("取り引き", "とりひき") == ["と", "ひ"]
    assert tx.ruby_of("かな", "かな") == []
    assert tx.ruby_of("日本", "") is None
    assert tx.ruby_of("代々木", "よよぎ") == ["よよぎ"]


def test_repetition_mark_is_one_run_for_ruby_and_two_for_the_linter(spark):
    assert one(spark, "代々木", tx.kanji_runs) == 2
    assert len(one(spark, "代々木", tx.ruby_segments)) == 1


def test_crawl_line(spark):
    parse = lambda line, floor=0.5: one(spark, line, lambda c: tx.crawl_pair(c, floor))
    assert tuple(parse("http://a\thttp://b\t0.7\tHello there\tこんにちは")) == ("こんにちは", "Hello there")
    assert parse("http://a\thttp://b\t0.3\tHello there\tこんにちは") is None
    assert tuple(parse("http://a\tHello\tこんにちは")) == ("こんにちは", "Hello")
    assert parse("one field") is None and parse("a\tb") is None
    assert tuple(parse("0.9\tこんにちは")) == ("こんにちは", "0.9")  # the score is all that is left


def test_refusal(spark):
    from bitloom.operators.hygiene import teacher_reason

    reason = lambda en: spark.createDataFrame([("日本語の文です", en)], "ja string, en string").select(teacher_reason(F.col("ja"), F.col("en")).alias("r")).first()["r"]
    assert reason("I am a student.") == "refusal"
    assert reason("Sorry, no") == "refusal"
    assert reason(" ") == "blank" and reason(None) == "blank"
    assert reason("日本語 text") == "cjk"
    assert reason("x" * 100) == "ratio"
    assert reason("A student.") is None


def test_numbers(spark):
    rate = lambda step: spark.range(1).select(tx.learning_rate(F.lit(step), 1.0, 1000).alias("y")).first()["y"]
    assert rate(1000) == pytest.approx(1.0) and rate(500) == pytest.approx(0.5) and rate(4000) == pytest.approx(0.5) and rate(0) == pytest.approx(0.001)


def test_normalization_of_other_scripts(spark):
    rows = spark.createDataFrame([(t,) for t in ("Éçeau aian à l'été", "ｶﾞ１２", "plain", "e\u0301", None, "")], "t string")
    assert [r[0] for r in rows.select(tx.normalize_text(F.col("t"))).collect()] == ["Éçeau aian à l'été", "ガ12", "plain", "é", None, ""]
