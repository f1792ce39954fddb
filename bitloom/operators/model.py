"""NumPy inference of an encoder-decoder transformer, for use inside mapInPandas; greedy and beam decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAD, BOS, EOS = 0, 1, 2


@dataclass(frozen=True)
class ModelConfig:
    vocab: int = 64
    width: int = 16
    heads: int = 2
    layers: int = 2
    hidden: int = 32
    rotary: bool = False
    tied: bool = True

    @classmethod
    def of(cls, values: dict) -> ModelConfig:
        """From a mapping; keys that aren't known are passed over."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})


Weights = dict[str, np.ndarray]


def new_weights(cfg: ModelConfig, seed: int = 0) -> Weights:
    """Seeded random weights in the layout that ``forward`` reads."""
    rng = np.random.default_rng(seed)
    w = {"embed": rng.normal(0, cfg.width**-0.5, (cfg.vocab, cfg.width))}
    if not cfg.tied:
        w["out"] = rng.normal(0, cfg.width**-0.5, (cfg.vocab, cfg.width))
    for side, kinds in (("enc", ("self",)), ("dec", ("self", "cross"))):
        for k in range(cfg.layers):
            for kind in kinds:
                for part in "qkvo":
                    w[f"{side}.{k}.{kind}.{part}"] = rng.normal(0, cfg.width**-0.5, (cfg.width, cfg.width))
            w[f"{side}.{k}.up"] = rng.normal(0, cfg.width**-0.5, (cfg.width, cfg.hidden))
            w[f"{side}.{k}.down"] = rng.normal(0, cfg.hidden**-0.5, (cfg.hidden, cfg.width))
    return w


def count_parameters(weights: Weights) -> int:
    """Numbers in distinct arrays."""
    return sum(a.size for a in {id(a): a for a in weights.values()}.values())


def sinusoids(length: int, width: int) -> np.ndarray:
    dims = np.arange(width)
    angle = np.arange(length)[:, None] / 10000.0 ** ((dims - dims % 2) / width)
    return np.where(dims % 2 == 0, np.sin(angle), np.cos(angle))


def rotate(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rotary positions: pairs of dimensions turned by angles that grow with the position."""
    half = x.shape[-1] // 2
    angle = at[:, None] / 10000.0 ** (np.arange(half) / half)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), a * np.sin(angle) + b * np.cos(angle)], -1)


def _norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Attention of (batch, heads, positions, dims); ``allowed`` broadcasts to (batch, heads, queries, keys)."""
    scores = np.where(allowed, q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1]), -1e9)
    return softmax(scores) @ v


class Transformer:
    def __init__(self, cfg: ModelConfig, weights: Weights) -> None:
        self.cfg, self.w = cfg, weights

    def _heads(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:2], self.cfg.heads, -1).swapaxes(1, 2)

    def _keys(self, name: str, x: np.ndarray, start: int, turn: bool) -> tuple[np.ndarray, np.ndarray]:
        k = self._heads(x @ self.w[f"{name}.k"])
        return (rotate(k, start + np.arange(x.shape[1])) if turn else k), self._heads(x @ self.w[f"{name}.v"])

    def _attention(self, name: str, x: np.ndarray, keys: tuple[np.ndarray, np.ndarray], allowed: np.ndarray, start: int, turn: bool) -> np.ndarray:
        q = self._heads(x @ self.w[f"{name}.q"])
        q = rotate(q, start + np.arange(x.shape[1])) if turn else q
        out = attend(q, *keys, allowed).swapaxes(1, 2)
        return out.reshape(x.shape) @ self.w[f"{name}.o"]

    def _feed(self, layer: str, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w[f"{layer}.up"]) @ self.w[f"{layer}.down"]

    def _embed(self, ids: np.ndarray, start: int = 0) -> np.ndarray:
        x = self.w["embed"][ids] * np.sqrt(self.cfg.width)
        return x if self.cfg.rotary else x + sinusoids(start + ids.shape[1], self.cfg.width)[start:]

    def encode(self, src: np.ndarray) -> np.ndarray:
        x, allowed = self._embed(src), (src != PAD)[:, None, None, :]
        for k in range(self.cfg.layers):
            name, y = f"enc.{k}", _norm(x)
            x = x + self._attention(f"{name}.self", y, self._keys(f"{name}.self", y, 0, self.cfg.rotary), allowed, 0, self.cfg.rotary)
            x = x + self._feed(name, _norm(x))
        return _norm(x)

    def decode(self, memory: np.ndarray, src: np.ndarray, tgt: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logits of all target positions; with ``cache`` of those of ``tgt``, which go on where the cache ends."""
        start = cache["length"] if cache else 0
        x, seen = self._embed(tgt, start), (src != PAD)[:, None, None, :]
        causal = np.arange(start + tgt.shape[1])[None, :] <= start + np.arange(tgt.shape[1])[:, None]
        for k in range(self.cfg.layers):
            name, y = f"dec.{k}", _norm(x)
            keys = self._keys(f"{name}.self", y, start, self.cfg.rotary)
            if cache is not None:
                if name in cache:
                    keys = tuple(np.concatenate([old, new], 2) for old, new in zip(cache[name], keys, strict=True))
                cache[name] = keys
            x = x + self._attention(f"{name}.self", y, keys, causal, start, self.cfg.rotary)
            cross = cache.get(f"{name}.cross") if cache is not None else None
            if cross is None:
                cross = self._keys(f"{name}.cross", memory, 0, False)
                if cache is not None:
                    cache[f"{name}.cross"] = cross
            x = x + self._attention(f"{name}.cross", _norm(x), cross, seen, 0, False)
            x = x + self._feed(name, _norm(x))
        if cache is not None:
            cache["length"] = start + tgt.shape[1]
        return _norm(x) @ self.w["embed" if self.cfg.tied else "out"].T

    def forward(self, src: np.ndarray, tgt: np.ndarray) -> np.ndarray:
        return self.decode(self.encode(src), src, tgt)

    def greedy(self, src: np.ndarray, longest: int, cached: bool = True) -> np.ndarray:
        """Ids from BOS on; behind EOS there is padding."""
        memory, out = self.encode(src), np.full((len(src), 1), BOS)
        cache: dict | None = {"length": 0} if cached else None
        done = np.zeros(len(src), bool)
        while out.shape[1] <= longest and not done.all():
            logits = self.decode(memory, src, out[:, -1:] if cached else out, cache)[:, -1]
            step = np.where(done, PAD, logits.argmax(-1))
            done |= step == EOS
            out = np.column_stack([out, step])
        return out

    def beam(self, src: np.ndarray, longest: int, width: int = 4, alpha: float = 0.6) -> np.ndarray:
        """Best hypothesis of each row by score over ((5 + n) / 6)^alpha. Ended ones only go on with padding at no cost."""
        found = [self._beam_one(row[None, row != PAD], longest, width, alpha) for row in src]
        out = np.full((len(found), max(map(len, found))), PAD)
        for i, ids in enumerate(found):
            out[i, : len(ids)] = ids
        return out

    def _beam_one(self, src: np.ndarray, longest: int, width: int, alpha: float) -> np.ndarray:
        memory = self.encode(src)
        beams, scores = np.full((1, 1), BOS), np.zeros(1)
        for _ in range(longest):
            ended = (beams == EOS).any(1)
            if ended.all():
                break
            n = len(beams)
            logp = log_softmax(self.decode(np.repeat(memory, n, 0), np.repeat(src, n, 0), beams)[:, -1])
            logp[ended] = -np.inf
            logp[ended, PAD] = 0.0
            total = (scores[:, None] + logp).ravel()
            best = np.argsort(-total, kind="stable")[:width]
            beams = np.column_stack([beams[best // self.cfg.vocab], best % self.cfg.vocab])
            scores = total[best]
        lengths = (beams != PAD).sum(1)
        return beams[np.argmax(scores / ((5.0 + lengths) / 6.0) ** alpha)]


def translate(rows: DataFrame, cfg: ModelConfig, weights: Weights, to_ids: Callable[[str], list[int]], to_text: Callable[[list[int]], str],
              longest: int = 64, batch: int = 32, beam: int = 1) -> DataFrame:
    """(id, hyp) of rows (id, src). Weights are broadcast once; rows of a batch are of similar length."""
    sent = rows.sparkSession.sparkContext.broadcast((cfg.__dict__, weights))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Transformer(ModelConfig.of(sent.value[0]), sent.value[1])
        for part in parts:
            ids = part["src"].map(lambda t: [*to_ids(t or ""), EOS])
            order = np.argsort(ids.map(len).to_numpy(), kind="stable")
            hyps = [""] * len(part)
            for a in range(0, len(order), batch):
                chosen = order[a : a + batch]
                width = max(len(ids.iloc[i]) for i in chosen)
                src = np.array([ids.iloc[i] + [PAD] * (width - len(ids.iloc[i])) for i in chosen])
                out = model.greedy(src, longest) if beam == 1 else model.beam(src, longest, beam)
                for i, row in zip(chosen, out.tolist(), strict=True):
                    cut = row[1 : row.index(EOS)] if EOS in row else row[1:]
                    hyps[i] = to_text([x for x in cut if x != PAD])
            yield pd.DataFrame({"id": part["id"].to_numpy(), "hyp": hyps})

    return rows.select("id", "src").mapInPandas(run, "id long, hyp string")


def smoothed_loss(logits: np.ndarray, gold: np.ndarray, epsilon: float = 0.1) -> tuple[float, int]:
    """Sum of label-smoothed cross entropies without padding, and the number of tokens (1 at least)."""
    logp = log_softmax(logits)
    own = np.take_along_axis(logp, gold[..., None], -1)[..., 0]
    each = -(1 - epsilon) * own - epsilon * logp.mean(-1)
    real = gold != PAD
    return float(each[real].sum()), max(1, int(real.sum()))
