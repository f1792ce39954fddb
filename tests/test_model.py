"""Forward pass, cache and decoding of the NumPy model."""

import numpy as np
import pytest

from bitloom.operators import model as m


@pytest.fixture(params=[False, True])
def net(request):
    cfg = m.ModelConfig(vocab=20, rotary=request.param, tied=not request.param)
    return m.Transformer(cfg, m.new_weights(cfg, 3))


SRC = np.array([[5, 6, 7, 2], [8, 2, 0, 0]])


def test_cache_agrees_with_the_full_pass(net):
    tgt = np.array([[1, 4, 9], [1, 3, 3]])
    memory, cache = net.encode(SRC), {"length": 0}
    steps = np.concatenate([net.decode(memory, SRC, tgt[:, k : k + 1], cache) for k in range(3)], 1)
    assert np.allclose(steps, net.forward(SRC, tgt))


def test_padding_does_not_matter(net):
    alone = net.forward(SRC[1:, :2], np.array([[1, 3]]))
    assert np.allclose(alone, net.forward(SRC, np.array([[1, 4], [1, 3]]))[1:])


def test_greedy(net):
    assert (net.greedy(SRC, 6) == net.greedy(SRC, 6, cached=False)).all()
    row = net.beam(SRC[:1], 6, width=1)[0]
    assert row.tolist() == net.greedy(SRC[:1], 6)[0].tolist()
    out = net.greedy(SRC, 6)
    for r in out.tolist():
        if m.EOS in r:
            assert set(r[r.index(m.EOS) + 1 :]) <= {m.PAD}


def test_loss():
    logits = np.zeros((2, 4, 10))
    gold = np.array([[1, 2, 3, 0], [4, 5, 0, 0]])
    flat, n = m.smoothed_loss(logits, gold)
    assert n == 5
    sure = logits.copy()
    np.put_along_axis(sure, gold[..., None], 9.0, -1)
    assert 0 < m.smoothed_loss(sure, gold)[0] < flat < m.smoothed_loss(-sure, gold)[0]


def test_parameters():
    cfg = m.ModelConfig.of({"vocab": 20, "unknown": 1})
    assert m.count_parameters(m.new_weights(cfg)) == 20 * 16 + 2 * (4 * 256 + 2 * 512) + 2 * (8 * 256 + 2 * 512)


def test_rotation_keeps_lengths_and_tells_distances():
    rng = np.random.default_rng(4)
    q, k = rng.normal(size=8), rng.normal(size=8)
    turned = lambda x, at: m.rotate(x[None], np.array([at]))[0]
    assert np.allclose(turned(q, 0), q) and np.isclose(np.linalg.norm(turned(q, 7)), np.linalg.norm(q))
    assert np.isclose(turned(q, 3) @ turned(k, 1), turned(q, 12) @ turned(k, 10))
    assert not np.isclose(turned(q, 3) @ turned(k, 1), turned(q, 3) @ turned(k, 2))


def test_beam_as_wide_as_all_hypotheses_finds_the_best():
    cfg = m.ModelConfig(vocab=5)
    small, src = m.Transformer(cfg, m.new_weights(cfg, 2)), np.array([[3, 4, 2]])
    scores = {}
    for a in range(5):
        for b in range(5) if a != m.EOS else [m.PAD]:
            logp = m.log_softmax(small.forward(src, np.array([[m.BOS, a]])))[0]
            total = logp[0, a] + (0.0 if a == m.EOS else logp[1, b])
            scores[m.BOS, a, b] = total / ((5 + sum(x != m.PAD for x in (m.BOS, a, b))) / 6) ** 0.6
    best = max(scores, key=scores.get)
    found = small.beam(src, 2, width=25)[0].tolist()
    assert tuple(found + [m.PAD] * (3 - len(found))) == best


@pytest.mark.parametrize("beam", [1, 3])
def test_translate_gives_each_row_its_own_text(spark, beam):
    cfg = m.ModelConfig(vocab=20)
    weights = m.new_weights(cfg, 3)
    to_ids = lambda t: [3 + ord(c) % 17 for c in t]
    to_text = lambda ids: " ".join(map(str, ids))
    texts = ["abc", "", None, "a longer text", "z", "abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, src string").repartition(2)
    made = {r["id"]: r["hyp"] for r in m.translate(rows, cfg, weights, to_ids, to_text, longest=6, batch=2, beam=beam).collect()}
    net = m.Transformer(cfg, weights)
    for i, t in enumerate(texts):
        src = np.array([[*to_ids(t or ""), m.EOS]])
        row = (net.greedy(src, 6) if beam == 1 else net.beam(src, 6, beam))[0].tolist()[1:]
        row = row[: row.index(m.EOS)] if m.EOS in row else row
        assert made[i] == to_text([x for x in row if x != m.PAD])
    assert m.translate(rows.where("id < 0"), cfg, weights, to_ids, to_text).count() == 0
