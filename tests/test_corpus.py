"""The funnel, statistics and splits on small inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.operators import corpus, hygiene, metrics

RAW = "source string, source_ord int, doc_id long, line_no int, ja_raw string, en_raw string"


def raw(spark, rows):
    return spark.createDataFrame([(s, o, i, 0, ja, en) for i, (s, o, ja, en) in enumerate(rows)], RAW)


def stages(df):
    return [r["stage"] for r in df.orderBy("doc_id").collect()]


def test_first_failing_stage(spark):
    rows = [("a", 0, "こんにちは", "Hello there"), ("a", 0, "", "x"), ("a", 0, "こんにちは", "H"), ("a", 0, "konnichiwa", "Hello there"), ("a", 0, "こんにちは", "hello THERE"), ("a", 0, "さようなら", "Good bye")]
    df = corpus.funnel_stages(raw(spark, rows))
    assert stages(df) == [None, "length", "ratio", "script", "dedup", None]
    row = corpus.funnel_counts(df).first()
    assert (row["input_pairs"], row["kept"], row["length"], row["ratio"], row["script"], row["dedup"]) == (6, 2, 1, 1, 1, 1)
    assert row["keep_rate"] == pytest.approx(0.3333)


def test_duplicates_across_sources_first_source_wins(spark):
    df = corpus.funnel_stages(raw(spark, [("b", 1, "こんにちは", "Hello there"), ("a", 0, "こんにちは", "Hello there")]))
    assert stages(df) == ["dedup", None]


def test_a_pair_that_langid_drops_still_suppresses_later_ones(spark):
    never = lambda c: F.struct(F.lit("xx").alias("lang"), F.lit(1.0).alias("conf"))
    long_ja = "こんにちはこんにちはこんにちは"
    df = corpus.funnel_stages(raw(spark, [("a", 0, long_ja, "Hello there my friend"), ("a", 0, long_ja, "hello there my friend"), ("a", 0, "短い", "Short")]), predict=never)
    assert stages(df) == ["langid", "dedup", None]


def test_empty_funnel(spark):
    assert corpus.funnel_counts(corpus.funnel_stages(raw(spark, []))).count() == 0


def test_length_stats(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "v int")
    row = corpus.length_stats(rows, F.col("v")).first()
    assert (row["n"], row["mean"], row["p50"], row["max"]) == (5, 22.0, 3, 100)
    assert tuple(corpus.length_stats(rows.where("false"), F.col("v")).first()) == (0, 0.0, 0, 0, 0)


@pytest.mark.parametrize(("n", "rule", "sizes"), [(1000, "share", (850, 100, 50)), (60, "share", (0, 40, 20)), (60, "fifth", (48, 6, 6)), (0, "share", (0, 0, 0))])
def test_splits(spark, n, rule, sizes):
    rows = spark.range(n).withColumnRenamed("id", "k")
    split = lambda seed: {r["k"]: r["split"] for r in corpus.split_holdout(rows, 100, 50, seed, [F.col("k").cast("string")], ["k"], rule).collect()}
    found = split(1)
    assert tuple(sum(x == s for x in found.values()) for s in ("train", "valid", "test")) == sizes
    assert found == split(1)
    if n == 1000:
        assert found != split(2)


def test_holdout_is_uniform(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    top = corpus.take_shuffled(rows, 400, 1, [F.col("k").cast("string")], ["k"])
    assert 2000 < top.agg(F.avg("k")).first()[0] < 3000


def test_upsert_and_rollup(spark):
    rows = [("r", "t", 1, None, 47.0, 1), ("r", "t", 1, None, 47.0, 2), ("r", "t", 2, None, 47.4, 3)]
    records = spark.createDataFrame(rows, "run string, test_set string, seed int, beam int, chrf double, version int")
    newest = corpus.latest(records, ["run", "test_set", "seed", "beam"], "version")
    assert newest.count() == 2
    row = corpus.rollup_results(newest, ["chrf"]).first()
    assert (row["seeds"], row["beam"]) == (2, 1) and row["chrf_mean"] == pytest.approx(47.2) and row["chrf_std"] == pytest.approx(0.2)


def test_lexicon(spark):
    rows = [(i, *r) for i, r in enumerate([(["neko"], ["cat"]), (["inu"], ["dog"]), (["neko", "inu"], ["cat", "dog"])] * 20)]
    pairs = spark.createDataFrame(rows, "id int, src array<string>, tgt array<string>")
    lex = hygiene.lexicon(pairs)
    assert {r["src"]: r["tgt"] for r in lex.collect()} == {"neko": "cat", "inu": "dog"}
    said = hygiene.translate_by_lexicon(spark.createDataFrame([(1, ["neko", "x", "neko", "inu"]), (2, ["x"])], "id int, src array<string>"), lex)
    assert {r["id"]: r["hyp"] for r in said.collect()} == {1: "cat dog", 2: ""}


def test_metrics(spark):
    pairs = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, hyp string, ref string")
    same = [("The quick brown fox jumps over the dog.", "The quick brown fox jumps over the dog.")]
    assert metrics.chrf(pairs(same)).first()[0] > 99 and metrics.bleu(pairs(same)).first()[0] > 99
    assert metrics.chrf(pairs([("zzzz", "The quick brown fox")])).first()[0] < 40
    assert metrics.chrf(pairs([("", "abc")])).first()[0] == 0.0 and metrics.bleu(pairs([("", "abc")])).first()[0] == 0.0
    # one order each: P = R = 2/3 for characters, 1/2 for pairs, 0 for triples
    assert metrics.chrf(pairs([("abd", "abc")])).first()[0] == pytest.approx(100 * (2 / 3 + 1 / 2 + 0) / 3)


@pytest.mark.parametrize("portion", [1 << 21, 30])
def test_ngrams_against_counters(spark, monkeypatch, portion):
    monkeypatch.setattr(metrics, "PORTION", portion)
    rng = random.Random(portion)
    texts = [["".join(rng.choice("abc 日𠮷") for _ in range(rng.randrange(14))) for _ in range(40)] for _ in range(2)]
    df = spark.createDataFrame([*zip(*texts, strict=True), (None, "ab"), ("ab", None)], "hyp string, ref string")
    for units, split, order in ((metrics.visible, lambda t: "".join(t.split()), 6), (lambda c: F.filter(F.split(c, " "), lambda w: w != ""), str.split, 4)):
        found = {r["n"]: (r["hyp"], r["ref"], r["hit"]) for r in metrics._matches(df, units, order).collect()}
        for n in range(1, order + 1):
            grams = lambda t: Counter(tuple(split(t or "")[k : k + n]) for k in range(len(split(t or "")) - n + 1))  # noqa: B023, E731
            pairs = [(grams(a), grams(b)) for a, b in [*zip(*texts, strict=True), (None, "ab"), ("ab", None)]]
            assert found[n] == tuple(sum(f(a, b) for a, b in pairs) for f in (lambda a, b: a.total(), lambda a, b: b.total(), lambda a, b: (a & b).total()))


def test_loss_of_nothing_and_weights(spark):
    rows = spark.createDataFrame([(2.0, 1), (6.0, 3)], "loss double, n_tokens long")
    assert tuple(metrics.mean_loss(rows).first()) == (2.0, 4)
    assert metrics.mean_loss(rows.where("false")).first()["n_tokens"] is None


def test_results_are_aligned(spark):
    lines = spark.createDataFrame([('{"custom_id": "row-1", "response": {"body": {"choices": [{"message": {"content": " x "}}]}}}',), ('{"custom_id": "row-2"}',)], "value string")
    assert [r["content"] for r in hygiene.align_to_range(hygiene.parse_results(lines), 4).orderBy("i").collect()] == [None, "x", None, None]
