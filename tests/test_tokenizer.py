"""Pre-tokens, BPE, batches; with property tests of the round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.operators import annotation as an
from bitloom.operators import tokenizer as tok

PLAIN = tok.Tokenizer([])
CLASSIC = {b"low": 5, b"lower": 2, b"newest": 6, b"widest": 3}


def test_classic_merges():
    assert tok.train_merges(CLASSIC, 2) == [(ord("e"), ord("s")), (256, ord("t"))]


def naive(freqs, count):
    words, merges = {w: list(w) for w in freqs}, []
    for k in range(count):
        seen = {}
        for w, ids in words.items():
            for p in zip(ids, ids[1:]):
                seen[p] = seen.get(p, 0) + freqs[w]
        if not seen:
            break
        best = min(seen, key=lambda p: (-seen[p], p))
        merges.append(best)
        words = {w: tok.merged(ids, best, 256 + k) for w, ids in words.items()}
    return merges


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=8).map(str.encode), st.integers(1, 9), max_size=12))
def test_training_agrees_with_recounting(freqs):
    assert tok.train_merges(freqs, 12) == naive(freqs, 12)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_round_trip(text):
    merges = tok.train_merges(CLASSIC, 8)
    for t in (PLAIN, tok.Tokenizer(merges)):
        assert t.decode(t.encode(text)) == text
    assert "".join(tok._PRETOKEN.findall(text)) == text


def test_special_tokens():
    wire = f"{an.HEADER}0.2{an.FIELD_SEP}x{an.RECORD_END}"
    ids = PLAIN.encode(wire, add_bos=True, add_eos=True)
    assert ids[0] == tok.BOS and ids[-1] == tok.EOS and ids[1] == 3 and PLAIN.decode(ids) == wire
    assert PLAIN.decode(ids, skip_special=False).startswith("<BOS>")
    assert PLAIN.decode([9999]) == "�" and PLAIN.decode([tok.OFFSET + 0xFF]) == "�"
    assert PLAIN.vocab_size == 268 and PLAIN.name_to_id("EOS") == 2
    with pytest.raises(KeyError):
        PLAIN.name_to_id("NOPE")


def test_pretokens(spark):
    cut = lambda s: spark.createDataFrame([(s,)], "x string").select(tok.pretokens(F.col("x")).alias("y")).first()["y"]
    assert cut("Hello  world 12漢字かなカナ!") == ["Hello", " ", " world", " 12", "漢字", "かな", "カナ", "!"]
    assert cut("") == []
    assert cut("a  ") == ["a", "  "]


def test_train_on_a_table(spark):
    df = spark.createDataFrame([("low low low low low lower lower",)], "x string")
    assert tok.train(df, "x", 270).vocab_size == 270
    assert tok.train(df, "x", 100000).vocab_size < 300
    with pytest.raises(ValueError):
        tok.train(df, "x", 100)


def test_save_and_load():
    t = tok.Tokenizer(tok.train_merges(CLASSIC, 5))
    assert tok.Tokenizer.from_json(t.to_json()).merges == t.merges
    assert t.prefix(270).merges == t.merges[:2]
    with pytest.raises(ValueError):
        tok.Tokenizer.from_json(t.to_json().replace('"version": 1', '"version": 9'))


def test_pack():
    assert tok.pack([1, 1, 1, 4], 4) == [0, 0, 0, 1]
    assert tok.pack([9, 1], 4) == [0, 1]
    lengths = sorted((7 * k) % 13 + 1 for k in range(200))
    batch = tok.pack(lengths, 64)
    for b in set(batch):
        own = [n for n, x in zip(lengths, batch) if x == b]
        assert len(own) * max(own) <= 64 and max(own) - min(own) <= 4


def test_batches(spark):
    rows = spark.range(200).select(F.col("id").alias("idx"), (F.col("id") * 7 % 13 + 1).cast("int").alias("length"))
    ids = lambda **k: sorted((r["batch_id"], r["idx"]) for r in tok.token_batches(rows, 64, **k).collect())
    assert sorted(i for _, i in ids()) == list(range(200))
    assert ids(seed=1) == ids(seed=1) != ids(seed=2) and ids(seed=1, epoch=1) == ids(seed=2)
    assert tok.token_batches(rows.where("false"), 64).count() == 0


def test_loader(spark):
    rows = [(i, [5] * (i % 7 + 1), [1] + [6] * (i % 3 + 1)) for i in range(120)]
    store = spark.createDataFrame(rows, "idx long, src array<int>, tgt array<int>").withColumn("length", F.greatest(F.size("src"), F.size("tgt")))
    seen, sizes = [], []
    for batch in tok.epochs(store, 64, seed=3):
        seen += [r["idx"] for r in batch]
        assert len({len(r["src"]) for r in batch}) == len({len(r["tgt"]) for r in batch}) == 1
        sizes.append(len(batch) * max(len(batch[0]["src"]), len(batch[0]["tgt"])))
        real = {r["idx"]: [x for x in r["src"] if x] for r in batch}
        assert all(real[i] == rows[i][1] for i in real)
        if len(seen) >= 240:
            break
    assert sorted(seen[:120]) == sorted(seen[120:]) == list(range(120)) and seen[:120] != seen[120:] and max(sizes) <= 64


def test_offsets_and_output_ids(spark):
    rows = spark.createDataFrame([(5, 3), (1, 4), (9, 2)], "i long, n long")
    assert [r["n_off"] for r in tok.offsets(rows, "i", ["n"]).orderBy("i").collect()] == [0, 4, 7]
    cut = lambda ids: spark.createDataFrame([(ids,)], "x array<int>").select(tok.output_ids(F.col("x")).alias("y")).first()["y"]
    assert cut([1, 20, 21, 2, 0]) == [20, 21] and cut([20]) == [20] and cut([1, 2]) == [] and cut([]) == []


def test_training_pairs_are_bounded_and_end(spark):
    rows = spark.createDataFrame([([10, 11, 12, 13], [20, 21, 22]), ([], [])], "s array<int>, t array<int>")
    src, tgt = tok.as_training_pair(F.col("s"), F.col("t"), 4)
    assert [tuple(r) for r in rows.select(src, tgt).collect()] == [([10, 11, 12, tok.EOS], [tok.BOS, 20, 21, tok.EOS]), ([tok.EOS], [tok.BOS, tok.EOS])]
